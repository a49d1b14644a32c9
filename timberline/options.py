"""Training options, with the names and defaults that users of the engine set."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class Impurity(Enum):
    Entropy = "Entropy"
    Gini = "Gini"


class Selection(Enum):
    MeanGainFiltered = "MeanGainFiltered"
    MaxGain = "MaxGain"


class Pruning(Enum):
    NoPruning = "None"
    PessimisticError = "PessimisticError"
    CostComplexity = "CostComplexity"


class Backend(Enum):
    """Accepted for compatibility; Spark runs every one of them."""

    Serial = "serial"
    Parallel = "parallel"
    Cuda = "cuda"


@dataclass(frozen=True)
class Options:
    backend: Backend = Backend.Parallel
    dataset_path: str = "datasets/covertype.csv"
    max_depth: int = -1
    min_samples_to_split: int = 2
    min_samples_per_leaf: int = 1
    pruning: Pruning = Pruning.NoPruning
    selection: Selection = Selection.MeanGainFiltered
    epsilon: float = 1e-9
    confidence_factor: float = 0.25
    ccp_alpha: float = 0.5
    impurity: Impurity = Impurity.Entropy
    #: 'adjacent' looks for a class change between neighbouring rows; 'all' takes every boundary between values.
    candidates: str = "adjacent"
    #: Rows of a node up to which one task grows its whole subtree.
    finish_rows: int = 10_000
    # Sizes of thread pools and device launches: kept, shown and without effect.
    max_feature_threads: int = 4
    max_node_threads: int = 4
    min_features_to_parallelize: int = 4
    min_rows_to_parallelize: int = 32
    cuda_rows_per_tile: int = 32768
    cuda_max_tiles_per_feature: int = 128
    cuda_score_threads: int = 256
    cuda_gather_block: int = 256


CART = Options(impurity=Impurity.Gini, selection=Selection.MaxGain)
C45 = Options(impurity=Impurity.Entropy, selection=Selection.MeanGainFiltered)


def apply_command_line(args: list[str], options: Options) -> Options:
    """``--serial --parallel --cuda -dN | -d N <path>``; the last path counts."""
    rest = iter(args)
    for arg in rest:
        if arg in ("--serial", "--parallel", "--cuda"):
            options = replace(options, backend=Backend(arg[2:]))
        elif arg.startswith("-d"):
            depth = arg[2:] or next(rest, None)
            if depth is None:
                raise ValueError("Option -d requires a value")
            options = replace(options, max_depth=int(depth))
        elif arg.startswith("-"):
            raise ValueError(f"Unknown option: {arg}")
        else:
            options = replace(options, dataset_path=arg)
    return options
