"""Command line: train on a CSV file, write the drawing, print the summary."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from timberline.operators.grow import fit
from timberline.operators.render import render_report, report, summary
from timberline.options import CART, Options, apply_command_line
from timberline.sources import load_positional


def main(args: list[str], options: Options = replace(CART, max_depth=7), svg_path: str = "tree.svg") -> int:
    try:
        options = apply_command_line(args, options)
        spark = SparkSession.builder.getOrCreate()
        df = load_positional(spark, options.dataset_path)
        print(f"Loaded samples: {df.count()}\nFeatures: {' '.join(df.columns[:-1])}\n")
        tree = fit(df, options)
        with open(svg_path, "w", encoding="utf-8") as out:
            out.write(render_report(report(tree, df, options)))
        print(summary(tree, df))
        return 0
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
