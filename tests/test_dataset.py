import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators import dataset as D
from pairloom.sources.examples import read_examples, write_examples

DATA = [
    (f"art{i % 4}", "c" if i % 3 else "cpp", f"f::n{i:03d}", "s" * (i * 7 % 50), "d" * (i * 13 % 41), (f"p{i % 9}", i))
    for i in range(200)
]
NATURAL = sorted(DATA, key=lambda r: (r[0], r[1], r[5][0], r[5][1], r[2]))


@pytest.fixture
def examples(spark):
    return spark.createDataFrame(DATA, schemas.EXAMPLES).repartition(7)


def idents(df):
    return [r.ident for r in df.select("ident").collect()]


def test_limit_count(examples):
    for count, skip in ((10, 0), (25, 180), (None, 150), (None, 0), (0, 3), (500, 0)):
        end = None if count is None else skip + count
        assert sorted(idents(D.limit_count(examples, count, skip))) == sorted(r[2] for r in NATURAL[skip:end])


def test_limit_code_types(examples):
    assert D.limit_code_types(examples, "c").count() == sum(1 for r in DATA if r[1] == "c")
    assert D.limit_code_types(examples, ["c", "cpp"]).count() == 200
    with pytest.raises(ValueError):
        D.limit_code_types(examples, "rust")


def test_shuffle_is_a_permutation_that_ignores_layout(examples, rows):
    a = rows(D.with_position(D.seeded_shuffle(examples, 3)), "idx", "ident")
    b = rows(D.with_position(D.seeded_shuffle(examples.repartition(2), 3)), "idx", "ident")
    c = rows(D.with_position(D.seeded_shuffle(examples, 4)), "idx", "ident")
    assert a == b != c
    assert sorted(i for i, _ in a) == list(range(200))
    assert D.seeded_shuffle(examples, 0) is examples


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.7, 0.999, 1.0])
def test_split(examples, ratio):
    left, right = D.split_off_end(examples, ratio)
    cut = int(200 * ratio)
    assert sorted(idents(left)) == sorted(r[2] for r in NATURAL[:cut])
    assert sorted(idents(right)) == sorted(r[2] for r in NATURAL[cut:])


def test_train_eval_split(examples):
    train, held_out = D.train_eval_split(examples, eval=0.75, code_types="c,cpp", count=100)
    assert (train.count(), held_out.count()) == (75, 25)
    train, held_out = D.train_eval_split(examples, eval=examples, code_types="c", count=20)
    assert train.count() == held_out.count() == 20
    assert D.train_eval_split(examples, eval=0, code_types="c,cpp")[1] is None
    assert D.train_eval_split(examples, code_types="c,cpp")[0].count() == 200


def test_sort_by_length_is_stable(examples):
    want = sorted(NATURAL, key=lambda r: max(len(r[3]), len(r[4])))
    assert idents(D.sort_by_length(examples)) == [r[2] for r in want]
    positions = D.with_position(D.sort_by_length(examples))
    assert [r.ident for r in positions.orderBy("idx").collect()] == [r[2] for r in want]


def test_render_and_inspect(examples):
    listing = D.render_examples(examples).orderBy("idx").collect()
    first = NATURAL[0]
    assert listing[0].rendered == (
        f"  0: {first[2]} (C)\n    source:\n      {first[3]}\n    decompiled:\n      {first[4]}"
    )
    picked = D.inspect_examples(examples, "cpp", count=5, skip=2, seed=9).orderBy("idx").collect()
    shuffled = [r.ident for r in D.seeded_shuffle(examples, 9).where("code_type = 'cpp'").orderBy("shuffle_key").collect()]
    assert [r.rendered.split(": ")[1].split(" ")[0] for r in picked] == shuffled[2:7]
    assert [r.idx for r in picked] == [0, 1, 2, 3, 4]


def test_soft_cap_keeps_a_prefix_and_the_crossing_file(spark, rows):
    files = [("hot", "source", f"p{i:02d}", "c", n) for i, n in enumerate([3, 0, 4, 0, 5, 1])] + [("b", "source", "q", "c", 99)]
    df = spark.createDataFrame(files, "artifact string, side string, path string, code_type string, new_ids long")
    kept = D.soft_cap_files(df, 7)
    assert rows(kept, "artifact", "path") == [("b", "q"), ("hot", "p00"), ("hot", "p01"), ("hot", "p02")]
    assert D.soft_cap_files(df, 0).count() == 7


def test_artifact_cutoff(examples):
    # 50 examples per artifact; the total must exceed the budget.
    for budget, artifacts in ((0, 4), (49, 1), (50, 2), (99, 2), (1000, 4)):
        assert D.artifact_cutoff(examples, budget).select("artifact").distinct().count() == artifacts


def test_save_and_load(spark, examples, tmp_path, rows):
    target = str(tmp_path / "set")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_examples(spark, target)
    write_examples(examples, target)
    with pytest.raises(Exception, match="already exists"):
        write_examples(examples, target)
    write_examples(examples, target, force=True)
    saved = read_examples(spark, target)
    assert rows(saved, *schemas.EXAMPLES.names) == rows(examples)
    # A saved set is in length order, so a split puts the longest last.
    left, right = D.split_off_end(saved, 0.9)
    longest = lambda df: df.agg(F.max("sort_len"), F.min("sort_len")).first()
    assert longest(left)[0] <= longest(right)[1]


def test_null_keys_are_in_no_part_twice_and_in_none_lost(spark):
    data = [(None if i % 2 else "a", None if i % 3 else "c", f"n{i}", "s", "d", ("p", i)) for i in range(10)]
    examples = spark.createDataFrame(data, schemas.EXAMPLES)
    left, right = D.split_off_end(examples, 0.5)
    assert left.count() == right.count() == 5
    assert sorted(idents(left) + idents(right)) == sorted(r[2] for r in data)
    assert D.limit_count(examples, 8).count() == 8 and D.with_position(examples).count() == 10


def test_artifacts_of_two_repos_are_cut_apart(spark):
    data = [(repo, "a", "c", f"n{i}", "s", "d", ("p", i)) for repo in ("r1", "r2") for i in range(5)]
    schema = "repo string, artifact string, code_type string, ident string, source string, decompiled string, " \
             "seq struct<path:string,pos:int>"
    examples = spark.createDataFrame(data, schema)
    assert {r.repo for r in D.artifact_cutoff(examples, 3).collect()} == {"r1"}
    assert D.artifact_cutoff(examples, 6).count() == 10


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_a_bijection_with_a_way_back(spark, n):
    got = spark.range(n).select("id", D.permuted(F.col("id"), n, 5).alias("p"), D.permuted(F.col("id"), n, 6).alias("q")) \
        .withColumn("back", D.permuted(F.col("p"), n, 5, inverse=True)).collect()
    assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    if n == 1000:  # spread, and another order for another seed
        assert sum(r.p == r.q for r in got) < 20 and sum(abs(r.p - r.id) < 10 for r in got) < 60


def test_shuffled_slices_read_their_rows_only(spark):
    numbered = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") * 3).alias("v"))
    parts = [[(r.place, r.idx, r.v) for r in D.shuffled_slice(numbered, 100, 9, 40, skip).collect()] for skip in (0, 40, 80, 120)]
    assert [len(p) for p in parts] == [40, 40, 20, 0]
    everything = sorted(sum(parts, []))
    assert [p for p, _, _ in everything] == list(range(100)) and sorted(i for _, i, _ in everything) == list(range(100))
    assert all(v == 3 * i for _, i, v in everything) and [i for _, i, _ in everything] != list(range(100))
