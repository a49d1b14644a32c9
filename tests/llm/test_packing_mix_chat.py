"""Packing, mixing, fingerprints and chats against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import merkle
from timberline.llm.chat import format_chats
from timberline.llm.mixture import curriculum, integral, mix, time_of
from timberline.llm.packing import pack, plan, tokenizer_path


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(1023, int(rng.paretovariate(0.7) * 20)) for _ in range(3000))
    made = plan(dict(counts))
    used = Counter()
    for combo, n in made:
        assert sum(combo) <= 1024
        for length in combo:
            used[length] += n
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 1024)
    assert sum(n for _, n in made) <= least * 1.01 + 2


def test_plan_fills_exactly():
    assert sum(n for _, n in plan({1000: 3, 24: 3})) == 3
    assert sum(n for _, n in plan({600: 2, 300: 2, 124: 2})) == 2
    assert sum(n for _, n in plan({400: 1, 300: 1, 200: 1, 124: 1})) == 1
    assert plan({}) == []


def test_packed_query_takes_added_tokens(spark, make, tmp_path):
    from tokenizers import Tokenizer

    import __spark_entry__ as entry

    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain words", "漢字 <|endoftext|>"]
    make(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert want[0].tolist() == [64, 220, 50256, 275, 2]
    got = entry.queries()["op7_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def decreasing(counts, capacity):
    """Sequences of best-fit decreasing, one piece after another."""
    gaps = [0] * (capacity + 1)
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                n, gap = n + 1, capacity
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return n


@pytest.mark.parametrize("kind", ["uniform", "skewed", "large", "few"])
def test_plan_is_no_worse_than_best_fit_decreasing(kind):
    rng = random.Random(len(kind))
    for capacity in (64, 200):
        draw = {"uniform": lambda k: rng.randint(1, 60), "skewed": lambda k: int(2000 / k**1.1) + 1, "large": lambda k: 40 if k > capacity // 3 else rng.randint(0, 2), "few": lambda k: rng.choice([0, 0, 0, 90])}[kind]
        counts = {k: n for k in range(1, capacity) if (n := draw(k))}
        made = plan(counts, capacity)
        used = Counter()
        for combo, n in made:
            assert sum(combo) <= capacity
            for k in combo:
                used[k] += n
        assert used == counts and sum(n for _, n in made) <= decreasing(counts, capacity)


def test_pack(make, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for i, t, *_ in odd:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = pack(make(odd)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(make([])).count() == 0


def test_curriculum(make, odd):
    rows = [(i, "w " * (i % 13), f"s{i % 4}") for i in range(200)] + [(1000, "a b", None), (1001, None, "s0"), (None, "q", "s1")]
    got = curriculum(make(rows)).collect()
    assert len(got) == len(rows)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source_size] += r.size
        target[r.source_size] = r.target
        taken[r.source_size] += r.taken
        assert r.taken <= 3 * r.size and (r.taken == 0) == (r.position is None)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))
    for s in target:
        assert taken[s] == pytest.approx(target[s], abs=1)
    assert min(target) == 2 and target[2] == 6.0  # the null source is last, small, and taken three times
    again = {r.doc_id: r.taken for r in curriculum(make(rows)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert curriculum(make([])).count() == 0 and curriculum(make([(1, None), (2, "")])).count() == 2


def test_schedules_move_sources_in_time(make):
    rows = [(i, "w w w", "early" if i % 2 else "late") for i in range(400)]
    got = curriculum(make(rows), schedules=[[(0, 4.0), (1, 0.0)], [(0, 0.0), (1, 4.0)]]).collect()
    mean = lambda s: np.mean([r.position for r in got if r.position is not None and (r.doc_id % 2 == 1) == s])
    assert mean(True) < 0.4 < 0.6 < mean(False)


@pytest.mark.parametrize("schedule", [2.0, [(0.2, 3.0), (0.6, 0.0), (0.6, 1.0), (0.9, 2.0)], [(0, 0.0), (1, 4.0)]])
def test_time_inverts_the_integral(spark, schedule):
    shares = np.linspace(0, 1, 201)
    rows = spark.createDataFrame([(float(u),) for u in shares], "u double")
    got = np.array([r[0] for r in rows.select(time_of(rows.u, schedule)).collect()])
    grid = np.linspace(0, 1, 400_001)
    knots = [(0.0, schedule)] if isinstance(schedule, float) else schedule
    weight = np.interp(grid, *zip(*[(t + 1e-9 * i, w) for i, (t, w) in enumerate(knots)]))
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / 400_000
    assert integral(schedule) == pytest.approx(area[-1], rel=1e-4)
    assert np.allclose(np.interp(got, grid, area) / area[-1], shares, atol=1e-4) and (np.diff(got) >= 0).all()


def test_mix_follows_the_schedules(make):
    """At each tenth of the time every source has the words that its schedule asks for, also where it repeats."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(1, 9), f"s{0 if i % 12 == 0 else 1 + i % 3}") for i in range(6000)]
    schedules = [[(0, 9.0), (1, 3.0)], [(0, 0.0), (1, 4.0)], 2.0]
    df = make(rows)
    plan = {r.doc_id: r for r in curriculum(df, schedules=schedules).collect()}
    target = {s: next(plan[i].target for i, _, x in rows if x == s) for s in ("s0", "s1", "s2", "s3")}
    got = [(r.source, len(r.text.split())) for r in mix(df, schedules=schedules).collect()]
    curves = dict(zip(target, [schedules[0], schedules[1], schedules[2], schedules[0]]))
    passes = {s: next(plan[i].passes for i, _, x in rows if x == s) for s in target}
    assert passes["s0"] == 3
    share = lambda s, t: np.trapezoid(np.interp(np.linspace(0, t, 1001), *zip(*(curves[s] if isinstance(curves[s], list) else [(0, curves[s])]))), dx=t / 1000) / integral(curves[s])
    total, seen, at = sum(target.values()), Counter(), 0
    for t in np.linspace(0.1, 1, 10):
        upto = sum(target[s] * share(s, t) for s in target)
        while at < len(got) and sum(seen.values()) < upto:
            seen[got[at][0]] += got[at][1]
            at += 1
        for s in target:
            assert seen[s] == pytest.approx(target[s] * share(s, t), abs=0.01 * total)


def test_mix_keeps_columns(make, odd):
    df = make([(*r, "s") if len(r) == 2 else r for r in odd])
    got = mix(df)
    assert got.columns == df.columns and {r.text for r in got.collect()} <= {r[1] for r in odd}
    assert mix(make([])).count() == 0
    unique = make([(i, "a b c", "s") for i in range(9)])
    assert mix(unique).columns == unique.columns and mix(unique).count() == 9


def plain_likeness(a: str, b: str) -> float:
    """Over all leaves, without the walk down the branches."""
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    x, y = merkle.leaves_of(a), merkle.leaves_of(b)
    return 2 * (x & y).total() / (x.total() + y.total())


def test_likeness_is_that_of_all_leaves():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé漢 \n") for _ in range(rng.randint(1, 9)))
    texts = ["".join(word() + rng.choice(["\n", " ", " "]) for _ in range(n)) for n in (0, 1, 2, 5, 30, 300, 3000) for _ in range(3)]
    texts += [t[: len(t) // 3] + "!" + t[len(t) // 3 :] for t in texts] + ["x" * 5000, "x" * 4999, "\n" * 40]
    trees = [merkle.tree(t.encode()) for t in texts]
    for a in trees:
        for b in trees:
            assert merkle.likeness(a, b) == pytest.approx(plain_likeness(a.mark, b.mark), abs=1e-12)
    assert all(merkle.likeness(a, b) > 0.9 for a, b in zip(trees[15:21], trees[36:42]))


def test_one_rule_for_short_texts():
    text = b"the quick brown fox jumps over the lazy dog and runs far away!!"
    near = lambda a, b: merkle.likeness(merkle.tree(a), merkle.tree(b))
    assert len(text) == 63 and near(text, text + b"ab") > 0.7 and near(text, b"z" + text) > 0.7


def test_lines_cut_in_groups_have_the_same_tree(monkeypatch):
    text = "\n".join(f"line {i} of {i * i} words" for i in range(500)).encode()
    whole = merkle.tree(text).mark
    monkeypatch.setattr(merkle, "TOGETHER", 100)
    assert merkle.tree(text).mark == whole


def test_fingerprints(make, odd):
    got = merkle.against_edit(make(odd)).collect()
    assert len(got) == len(odd)
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for (i, t, *_), (_, after, *_) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        change = len(t) // 4
        edited = t[: len(t) - change] + after[:change]
        assert any(r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t) and r.fingerprint == merkle.fingerprint(t) and r.edited_fingerprint == merkle.fingerprint(edited) for r in by[i])
        want = plain_likeness(merkle.fingerprint(t), merkle.fingerprint(edited)), plain_likeness(merkle.fingerprint(t), merkle.fingerprint(after))
        assert any((r.near_edited, r.near_next) == pytest.approx(want, abs=1e-12) for r in by[i])
    alone = merkle.against_edit(make([(1, "just one text")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert merkle.against_edit(make([])).count() == 0
    assert merkle.fingerprints(make([(1, "a"), (2, None)])).count() == 2


def test_fingerprints_locate_edits():
    lines = [f"line {i} has its own words {i * i} and more" for i in range(60)]
    a = merkle.fingerprint("\n".join(lines))
    old, lines[17] = merkle.tree("\n".join(lines).encode()), "something else"
    b = merkle.fingerprint("\n".join(lines))
    assert merkle.edited_paragraphs(b, a) == [17] and merkle.edited_paragraphs(a, a) == []
    assert 0.9 < merkle.likeness(old, merkle.tree("\n".join(lines).encode())) < 1


def test_chats(spark):
    long = [(1, i, "user", f"m{i}") for i in range(4)]
    rows = [*long, *[(2, *r[1:]) for r in long[:2]], *[(3, *r[1:]) for r in long], (4, 0, "user", "m0"), (4, 1, "user", "other"), (5, 0, None, None), (None, 0, "user", "z"), (6, 0, "user", "same"), (6, 0, "user", "same"), (7, None, "user", "same")]
    rows += [(8, i, "user", f"t{i}") for i in range(600)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, n string, conv string")
    got = {(r.conv_id, r.part): (r.n_turns, r.snapshots, r.rendered) for r in format_chats(df).collect()}
    assert {k for k in got} == {(1, 0), (4, 0), (5, 0), (None, 0), (6, 0), (8, 0), (8, 1)}  # 2, 3 and 7 are snapshots
    assert got[1, 0] == (4, 2, "".join(f"<|user|>\nm{i}<|end|>\n" for i in range(4)))
    assert got[6, 0][2].count("same") == 2 and got[8, 1][2].startswith("<|user|>\nt512")
    assert format_chats(df.limit(0)).count() == 0
