"""Edge cases of the operators made of built-in functions."""

from pyspark.sql import functions as F

from pairloom.llm import line_dedup, line_quality, mixing, preference

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def letters(prefix, n):
    """The same without digits, which count as equal in normalised lines."""
    return words(prefix, n).translate(str.maketrans("0123456789", "abcdefghij"))


# Preference pairs


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")


def test_common_prefix_is_the_prompt_and_masks_cover_the_assistant(spark):
    rows = [(1, side, t, role, text) for side, last in (("chosen", "good"), ("rejected", "bad"))
            for t, role, text in ((0, "user", "hi"), (1, "assistant", "yes?"), (2, "user", "go"), (3, "assistant", last))]
    got = preference.preference_pairs(turns(spark, rows)).first()
    assert got["n_prompt_turns"] == 3
    assert got["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes?<|end|>\n<|user|>\ngo<|end|>\n"
    start, end = map(int, got["chosen_spans"].split(":"))
    assert got["chosen"][start:end] == "good<|end|>\n" and end == len(got["chosen"])
    assert got["rejected"] == "<|assistant|>\nbad<|end|>\n"


def test_equal_turns_after_a_difference_are_not_shared(spark):
    rows = [(1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "b"),
            (1, "chosen", 1, "user", "c"), (1, "rejected", 1, "user", "c")]
    got = preference.preference_pairs(turns(spark, rows)).first()
    assert got["n_prompt_turns"] == 0 and got["prompt"] == "" and got["chosen"].count("c<|end|>") == 1


def test_preference_edges(spark):
    rows = [
        (1, "chosen", 0, "user", "same"), (1, "rejected", 0, "user", "same"),  # equal throughout
        (2, "chosen", 0, "user", "x"), (2, "chosen", 1, "assistant", "y"), (2, "rejected", 0, "user", "x"),
        (3, "chosen", 0, None, None), (3, "chosen", 0, None, None),  # nulls, repeated row, one side missing
        (None, "chosen", 0, "user", "p"), (None, "rejected", None, "user", "q"), (4, "other", 0, "user", "z"),
    ]
    df = turns(spark, rows).withColumn("part", F.lit(1)).withColumn("shared", F.lit(2))
    got = {r["pair_id"]: r for r in preference.preference_pairs(df).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1]["chosen"] == got[1]["rejected"] == "" and got[1]["n_prompt_turns"] == 1
    assert got[2]["rejected"] == "" and got[2]["chosen_spans"] == "14:23"
    assert got[3]["chosen"] == "<||>\n<|end|>\n" and got[3]["n_prompt_turns"] == 0
    assert got[None]["rejected"] == "<|user|>\nq<|end|>\n"
    assert preference.preference_pairs(turns(spark, [])).count() == 0


# Line quality


def test_frequent_lines_are_counted_per_host_and_removed(spark, frame):
    notice = "All  Rights Reserved 2020"
    rows = [(i, f"{letters(f'w{i}x', 60)}\n{notice if i % 2 else notice.lower().replace('2020', '1999')}", "h")
            for i in range(12)]
    rows += [(100, f"{letters('q', 60)}\n{notice}", "other"), (101, f"{notice}\n{letters('z', 3)}", "h")]
    docs = frame(rows, "doc_id long, text string, source string")
    limits = {"min_texts": 11, "min_share": 0.1}
    got = {r["doc_id"]: r for r in line_quality.judge(docs, **limits).collect()}
    assert [got[i]["n_frequent_words"] for i in (0, 1, 100, 101)] == [4, 4, 0, 4]
    assert got[0]["kept"] and got[100]["kept"] and not got[101]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.remove_frequent_lines(docs, **limits).collect()}
    assert cleaned[1] == letters("w1x", 60) and cleaned[100].endswith(notice) and cleaned[101] == letters("z", 3)


def test_depleted_documents_are_rejected(spark, frame):
    shared = "\n".join(letters(f"s{k}x", 40) for k in range(5))
    rows = [(i, f"{shared}\n{letters(f'own{i}x', 55)}", "h") for i in range(12)]
    got = line_quality.judge(frame(rows, "doc_id long, text string, source string"), min_texts=11, min_share=0.1)
    assert {(r["n_frequent_words"], r["base_failed"], r["kept"]) for r in got.collect()} == {(200, False, False)}


def notices(host, texts, holders, first=0):
    return [(first + i, f"{letters(f'{host}{i}x', 60)}" + ("\nread our Terms 7" if i < holders else ""), host)
            for i in range(texts)]


def test_production_limits_act_in_small_and_in_large_hosts(spark, frame):
    """Five texts and a twentieth of a host, or more than two hundred texts."""
    rows = [*notices("p", 20, 5), *notices("q", 20, 4, 100), *notices("r", 400, 20, 1000), *notices("s", 400, 19, 2000),
            *notices("t", 4300, 201, 10_000), *notices("u", 4300, 200, 20_000)]
    got = line_quality.judge(frame(rows, "doc_id long, text string, source string"))
    found = {r["h"]: r["n"] for r in got.groupBy(F.when(F.col("doc_id") < 100, "p").when(F.col("doc_id") < 1000, "q")
             .when(F.col("doc_id") < 2000, "r").when(F.col("doc_id") < 10_000, "s").when(F.col("doc_id") < 20_000, "t")
             .otherwise("u").alias("h")).agg(F.sum("n_frequent_words").alias("n")).collect()}
    assert found == {"p": 20, "q": 0, "r": 80, "s": 0, "t": 804, "u": 0}


def test_copies_are_not_boilerplate(spark, frame):
    text = "\n".join(letters(f"c{k}x", 30) for k in range(4))
    rows = [(i, text, "h") for i in range(30)] + notices("h", 30, 0, 100)
    got = line_quality.judge(frame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["n_frequent_words"] == 0 and r["kept"] for r in got)


def test_lines_go_from_the_given_table(spark, sf):
    """The limits act on given documents: a notice that stands in many documents of a host."""
    got = line_quality.judge(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet"))
    assert got.agg(F.sum("n_frequent_words")).first()[0] > 0


def test_line_quality_edges(spark, frame):
    rows = [(1, None, None), (2, "", "h"), (3, "a a a a", "h"), (4, " \n\t\n", "h"), (None, "x y", None),
            (5, "l one\nl one\n\nl one ", "h"), (5, "l one\nl one\n\nl one ", "h"), (6, "a b c d a b c", "h")]
    docs = frame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(9)).withColumn("line", F.lit(1))
    got = line_quality.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[3]["n_repeat_words"] == 4 and by[4]["n_dup_lines"] == 0 and by[5]["n_dup_lines"] == 1
    assert by[6]["n_repeat_words"] == 6
    assert line_quality.judge(docs.limit(0)).count() == 0
    assert line_quality.remove_frequent_lines(docs).columns == docs.columns


# Line dedup


def lines_left(df):
    return {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(df).collect()}


def test_later_passages_go_and_the_first_stays(spark, frame):
    passage = "\n".join(words(f"p{k}x", 20) for k in range(3))
    tail = "short tail line"
    rows = [(1, f"{words('a', 9)}\n{passage}\n{tail}\n{words('b', 9)}"),
            (2, f"{words('c', 9)}\n{passage}\n{tail}\n{words('d', 9)}"), (3, words("e", 9))]
    got = lines_left(frame(rows))
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == f"{words('c', 9)}\n{words('d', 9)}"


def test_a_passage_that_goes_on_differently_is_followed_in_each_group(spark, frame):
    start, one, two = words("w", 55), words("x", 40), words("y", 40)
    rows = [(1, f"{start}\n{one}"), (2, f"{start}\n{two}"), (3, f"{start}\n{two}"), (4, f"{start}\n{two}\n{words('z', 5)}"),
            (5, f"{start}\n{one}\n{two}")]
    got = lines_left(frame(rows))
    assert got == {1: rows[0][1], 2: two, 3: "", 4: words("z", 5), 5: two}


def test_no_repeated_tail_is_left(spark, frame):
    import random
    draw = random.Random(11)
    pool = [words(f"l{k}x", draw.choice([3, 9, 20, 26, 60])) for k in range(9)]
    rows = [(d, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))) for d in range(40)]
    got = lines_left(frame(rows))
    # Whatever is left holds no run of 50 words that an earlier document holds as it was.
    texts = dict(rows)
    for d, left in got.items():
        for e in range(d):
            assert not shares_run(left.split("\n"), texts[e].split("\n"), texts[d].split("\n"))


def shares_run(left, other, whole):
    """A run of 50 words that stands in all three, where ``left`` is what was kept of ``whole``."""
    for a in range(len(left)):
        for b in range(len(other)):
            n = size = 0
            while a + n < len(left) and b + n < len(other) and left[a + n] == other[b + n]:
                size += len(left[a + n].split())
                n += 1
            if size >= 50 and any(whole[i:i + n] == left[a:a + n] for i in range(len(whole))):
                return True
    return False


def test_short_repeats_stay(spark, frame):
    rows = [(i, f"{words('same', 49)}\n{words(f'own{i}x', 10)}") for i in range(5)]
    assert lines_left(frame(rows)) == dict(rows)


def test_one_line_of_fifty_words_is_enough(spark, frame):
    rows = [(i, f"{words(f'own{i}x', 10)}\n{words('same', 50)}\n{words(f'end{i}x', 10)}") for i in range(4)]
    got = lines_left(frame(rows))
    assert got[0] == rows[0][1] and all(words("same", 50) not in got[i] for i in (1, 2, 3))


def test_repeats_within_one_document(spark, frame):
    line = words("r", 25)
    got = lines_left(frame([(1, "\n".join([line] * 10))]))
    assert got[1] == "\n".join([line] * 2)  # the first window is two lines


def test_line_dedup_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, LONG), (4, LONG), (4, LONG), (5, "x"), (5, "y")]
    docs = frame(rows).withColumn("lines", F.lit(1)).withColumn("pos", F.lit("p")).withColumn("window", F.lit(0))
    got = line_dedup.remove_repeats(docs)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(rows)
    by = sorted((str(r["doc_id"]), r["text"] if r["text"] is None else len(r["text"])) for r in got.collect())
    assert ("1", None) in by and ("2", 0) in by and ("3", 2) in by and ("None", len(LONG)) in by
    assert by.count(("4", 0)) == 2
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_group_of_copies_keeps_one(spark, frame):
    rows = [(i, f"{LONG}\n{LONG}x") for i in range(300)]
    got = lines_left(frame(rows))
    assert got[0] == rows[0][1] and all(not got[i].strip() for i in range(1, 300))


# Mixing


def mixed(docs, **kw):
    return {r["doc_id"]: r for r in mixing.mix_documents(docs, **kw).collect()}


def test_sources_come_near_their_targets(spark, frame):
    rows = [(i, words("w", 50 + i % 90), f"s{i % 7}") for i in range(700)]
    got = list(mixed(frame(rows, "doc_id long, text string, source string")).values())
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - total) < 64 * 7
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 128
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_full_sources_stop_at_three_times_their_size(spark, frame):
    rows = [(1, words("a", 64), "a"), (2, words("b", 6400), "b"), (3, words("c", 64), "c")]
    got = mixed(frame(rows, "doc_id long, text string, source string"))
    assert got[1]["target"] == 192 and got[3]["target"] == 192 and got[1]["taken"] == 192
    assert got[2]["target"] == 6528 - 384 and got[2]["taken"] == 6144


def test_apportionment_is_by_highest_quotients(spark):
    parties = spark.createDataFrame([(k, v, 10) for k, v in zip("abcd", (53.0, 24.0, 23.0, 0.0))], "k string, t double, n long")
    got = {r["k"]: r["q"] for r in mixing.apportion(parties, [], F.col("k"), "t", "n", F.lit(100), "q").collect()}
    quotients = sorted(((-v / (2 * i + 1), k) for k, v in zip("abc", (53, 24, 23)) for i in range(10)))[:10]
    assert got == {k: sum(q[1] == k for q in quotients) for k in "abcd"}


def test_mixing_edges(spark, frame):
    rows = [(1, None, None), (2, "", "a"), (None, "x y z", "a"), (3, words("w", 300), None), (4, words("v", 200), "b"),
            (4, words("v", 200), "b")]
    docs = frame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("own")).withColumn(
        "quota", F.lit(1))
    got = mixing.mix_documents(docs)
    assert got.count() == len(rows) and "quota" in got.columns and dict(got.dtypes)["target"] == "double"
    assert {r["taken"] for r in got.collect() if not r["size"]} == {0}
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    again = frame(rows[::-1], "doc_id long, text string, source string")
    assert sorted(map(str, got.select("doc_id", "taken").collect())) == sorted(
        map(str, mixing.mix_documents(again).select("doc_id", "taken").collect()))
