import random

from runloom.llm import truncation

NOUNS = ["parser", "buffer", "daemon", "index", "wheel", "cursor", "timer", "ledger", "map", "validator", "io", "interpreter", "queue", "log", "semaphore", "image"]


def sentence(rng):
    return rng.choice(["The {} keeps the {} under load.", "Should the {} really drop the {}?", "We moved the {} next to the {}."]).format(rng.choice(NOUNS), rng.choice(NOUNS))


def test_cut_texts_are_told_from_whole_ones(spark):
    rng = random.Random(4)
    rows, cut, limit = [], set(), set()
    for i in range(3000):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 7))) + rng.choice(["", "", " Let me look at the rest next..."])
        source = rng.choice(["a", "b"])
        if i % 20 == 0:
            at = rng.randrange(30, len(text) - 5)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at += 1
                if at >= len(text) - 1:
                    at = 30
            text = text[:at] + rng.choice(["", "", " [output cut]", "..."])
            cut.add(i)
        elif source == "b" and len(text) > 215:
            text = text[:215].rstrip()
            if text[-1] not in ".?":  # a text that a limit cut at the end of a sentence looks whole
                limit.add(i)
        rows.append(("observation", i, source, text))
    rows += [("observation", 1, rows[1][2], rows[1][3]), ("observation", 5000, "a", None), ("observation", 5001, None, "  ")]
    df = spark.createDataFrame(rows, "field string, record_id long, source string, text string").where("trim(text) <> ''")
    got = {r["record_id"]: r for r in truncation.find_truncated(df).collect()}
    found = {i for i, r in got.items() if r["truncated"]}
    assert limit <= found
    assert len(cut & found) >= 0.97 * len(cut) and len(found - cut - limit) <= 3
    report = {r["source"]: r for r in truncation.report(truncation.find_truncated(df)).collect()}
    assert report["b"]["truncated"] == sum(1 for i in found if got[i]["source"] == "b")


def test_a_lost_last_character_is_a_cut_however_many_there_are(spark):
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 7)))
        if i % 10 == 0:  # 150 texts, each of its own length
            text = text[: rng.randrange(20, len(text) - 5)].rstrip() + rng.choice(["\ufffd", " \ufffd", "\ufffd\ufffd", "\ufffd...", "\ufffd [truncated]", "\ufffd \n"])
            cut.add(i)
        rows.append(("response", i, "a", text))
    rows.append(("response", 5000, "b", "\ufffd"))
    df = spark.createDataFrame(rows, "field string, record_id long, source string, text string")
    found = {r["record_id"] for r in truncation.find_truncated(df).where("truncated").collect()}
    assert cut | {5000} <= found and len(found - cut) <= 3


def test_a_rare_layout_does_not_acquit_its_only_cut(spark):
    rng = random.Random(6)
    rows = [("response", i, "a", f"{sentence(rng)} <tool> {sentence(rng)}") for i in range(1500)]
    rows += [("response", 2000 + i, "a", f"# 1: 2 {sentence(rng)} <tool> {sentence(rng)}") for i in range(30)]
    rows.append(("response", 3000, "a", f"# 1: 2 {sentence(rng)} <tool"))
    df = spark.createDataFrame(rows, "field string, record_id long, source string, text string")
    assert [r["record_id"] for r in truncation.find_truncated(df).where("truncated").collect()] == [3000]


def test_whole_texts_of_one_length_are_no_cuts(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 7)))
        if i % 3 == 0:  # as long as the limit, with their own end
            text = (text * 3)[:300].rsplit(" ", 2)[0]
            text = text + " " + "f" * (298 - len(text)) + "."
        rows.append(("response", i, "a", text))
    df = spark.createDataFrame(rows, "field string, record_id long, source string, text string")
    assert truncation.find_truncated(df).where("truncated").count() == 0


def test_the_vocabulary_is_bounded(spark):
    rows = [("response", i, "a", f"{' '.join(NOUNS)} word{i} ends here.") for i in range(200)]
    df = spark.createDataFrame(rows, "field string, record_id long, source string, text string")
    some = truncation.find_truncated(df, truncation.TruncationParams(vocabulary=3)).collect()
    assert len(some) == 200 and not any(r["truncated"] for r in some)
