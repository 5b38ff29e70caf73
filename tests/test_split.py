import hashlib
import random
import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import audit, contracts, split
from plumbline.operators.graph import connected_components


def manifest(spark, rows):
    df = spark.createDataFrame(rows, "path string, label string, sha256 string")
    return df.withColumns({"source_id": paths.source_id(F.col("path")), "derived": paths.is_derived(F.col("path"))})


def base(extra=()):
    return [(f"{c}/{i}.png", str(c), f"h{c}-{i}") for c in range(3) for i in range(10)] + list(extra)


def sides(df):
    return {r.path: r.split for r in df.collect()}


def test_base_split_isolates_and_covers(spark):
    m = manifest(spark, base([("0/duplicate.png", "0", "h0-0")]))
    a = split.verified(split.split(m))
    got = sides(a)
    assert len(got) == 31
    assert got["0/duplicate.png"] == got["0/0.png"]
    for s in ("train", "validation"):
        assert {p[0] for p, x in got.items() if x == s} == {"0", "1", "2"}
    assert sum(x == "validation" for x in got.values()) == 6
    assert sides(split.split(m)) == got  # the same each time
    assert sides(split.split(m, seed=7)) != got


def test_order_of_input_does_not_matter(spark):
    rows = base()
    assert sides(split.split(manifest(spark, rows))) == sides(split.split(manifest(spark, rows[::-1])))


def test_conflicts_are_quarantined(spark):
    m = manifest(spark, base([("0/duplicate.png", "0", "h0-0"), ("1/wrong.png", "1", "h0-0")]))
    assert audit.conflict_groups(m).count() == 1 and audit.conflict_members(m).count() == 3
    with pytest.raises(ValueError):
        split.split(m, policy="error")
    a = split.split(m).cache()
    meta = split.metadata(m, a).first()
    assert (meta.source_images, meta.excluded_conflicting_hashes, meta.excluded_conflicting_images) == (32, 1, 3)
    assert all(r.ok for r in contracts.accounting(split.metadata(m, a)).collect())
    with pytest.raises(ValueError):
        split.split(m, expected=4)


def test_single_group_stays_in_train(spark):
    m = manifest(spark, [*base()[:20], ("2/only.png", "2", "x")])
    a = split.split(m).cache()
    assert [r.label for r in split.train_only(a).collect()] == ["2"]
    assert sides(a)["2/only.png"] == "train"


def test_large_duplicate_group_is_not_chosen(spark):
    m = manifest(spark, base([(f"0/copy-{i}.png", "0", "h0-0") for i in range(40)]))
    assert not any(p.startswith("0/copy-") and s == "validation" for p, s in sides(split.split(m)).items())


def test_families_stay_together_and_derived_rows_are_held_out(spark):
    extra = [(f"{c}/{i}__{k}.png", str(c), f"d{c}-{i}-{k}") for c in range(3) for i in range(10) for k in ("aug_d3", "erode_k3_it1__aug_shift5")]
    got = sides(split.verified(split.split(manifest(spark, base(extra)))))
    for c in range(3):
        for i in range(10):
            family = {got[f"{c}/{i}.png"], got[f"{c}/{i}__aug_d3.png"], got[f"{c}/{i}__erode_k3_it1__aug_shift5.png"]}
            assert family in ({"train"}, {"validation", "held_out_derived"})


def test_frozen_split_is_reused_or_rejected(spark):
    a = split.split(manifest(spark, base())).cache()
    frozen = split.reuse(None, a, {"seed": 42})
    assert split.reuse(frozen, a, {"seed": 42}) == frozen
    with pytest.raises(ValueError, match="seed"):
        split.reuse(frozen, a, {"seed": 1})
    with pytest.raises(ValueError, match="hash"):
        split.reuse(frozen, a.withColumn("sha256", F.concat("sha256", F.lit("x"))), {"seed": 42})


def test_empty_and_single_class(spark):
    with pytest.raises(ValueError):
        split.split(manifest(spark, base()[:10]))
    assert split.families(manifest(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == 5000


def files(spark, m, without=(), changed=(), more=()):
    rows = [(r.path, "other" if r.path in changed else r.sha256) for r in m.collect() if r.path not in without]
    return spark.createDataFrame([*rows, *[(p, "x") for p in more]], "path string, sha256 string")


@pytest.mark.parametrize(
    "case, message",
    [("good", None), ("map", "label_mapping"), ("count", "manifest_count"), ("escape", "path_escape"), ("twice", "duplicate_entries"), ("label", "unknown_labels"), ("missing", "missing_files"), ("hash", "content_hash"), ("overlap", "sha256_overlap"), ("source", "source_id_overlap"), ("extra", None)],
)
def test_preflight(spark, case, message):
    rows = [("a/1.png", "a", "h1", "a/1", "train"), ("b/1.png", "b", "h2", "b/1", "train"), ("a/2.png", "a", "h3", "a/2", "validation"), ("b/2.png", "b", "h4", "b/2", "validation")]
    change = {"escape": (0, ("../1.png", "a", "h1", "a/1", "train")), "twice": (1, rows[0]), "label": (1, ("b/1.png", "c", "h2", "b/1", "train")), "overlap": (2, ("a/2.png", "a", "h1", "a/2", "validation")), "source": (2, ("a/2.png", "a", "h3", "a/1", "validation"))}
    if case in change:
        rows[change[case][0]] = change[case][1]
    m = spark.createDataFrame(rows, "path string, label string, sha256 string, source_id string, split string")
    labels = spark.createDataFrame([("a", 0), ("b", 2 if case == "map" else 1)], "label string, idx int")
    f = files(spark, m, without=["b/1.png"] if case == "missing" else [], changed=["b/1.png"] if case == "hash" else [], more=["z/9.png"] if case == "extra" else [])
    checks = contracts.preflight(m, labels, f, 3 if case == "count" else 2, 2, 2, verify_hashes=True).cache()
    if message is None:
        contracts.raise_first(checks.where("ord > 0"))
        assert checks.where("check = 'extra_files'").first().violations == (case == "extra")
    else:
        with pytest.raises(ValueError, match=message):
            contracts.raise_first(checks.where("ord > 0"))


def plain_assign(sizes, fraction=0.2, seed=42):
    """The groups of each label that go to validation, one by one."""
    out = set()
    for label in {lab for lab, _ in sizes}:
        groups = sorted((hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g, n) for (lab, g), n in sizes.items() if lab == label and n)
        if len(groups) < 2:
            continue
        target = sum(n for *_, n in groups) * fraction
        head = min(groups, key=lambda x: (abs(x[2] - target), x))
        out.add((label, head[1]))
        held, rest = head[2], [g for g in groups if g != head]
        for _, g, n in rest[:-1]:
            if abs(held + n - target) < abs(held - target):
                held += n
                out.add((label, g))
    return out


@pytest.mark.parametrize(("digits", "seed"), [(1, 0), (1, 1), (3, 2), (2, 3)])
def test_groups_against_plain_loops(spark, monkeypatch, digits, seed):
    monkeypatch.setattr(split, "DIGITS", digits)
    r = random.Random(seed)
    sizes = {}
    for label, n, most in (("few", 2, 3), ("one", 1, 5), ("many", 300, 1), ("mixed", 120, 30), ("large", 20, 200), ("skewed", 60, 2), ("pair", 3, 50)):
        for i in range(n):
            sizes[label, f"{label}{i}"] = r.randint(1, most) if r.random() < 0.9 else 0
    sizes["skewed", "skewed0"] = 500
    rows = [(lab, g, False) for (lab, g), n in sizes.items() for _ in range(n)] + [(lab, g, True) for lab, g in sizes]
    got = split.assign(spark.createDataFrame(rows, "label string, grp string, derived boolean").repartition(6), seed=seed)
    want = plain_assign(sizes, seed=seed)
    assert {(x.label, x.grp) for x in got.where("split = 'validation'").distinct().collect()} == {w for w in want if sizes[w]}
    assert {(x.label, x.grp) for x in got.where("split = 'held_out_derived'").collect()} == want
    assert got.count() == len(rows)
