import random
from collections import Counter

import corpus_pipeline as p
from test_jaccard import brute
from test_small_operators import check_shards

from framelake.llm import mixing


def rows():
    r = random.Random(9)
    words = {"en": "the of and in to house river stone light green old walk".split(), "de": "der die und das haus berg licht alt gehen stein gruen weg".split()}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    out = [(i, text("en" if i % 3 else "de", r.randint(20, 60)), "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, 1) for i in range(90)]
    base = text("en", 80).split()
    for i in range(100, 112):
        copy = list(base)
        copy[r.randrange(len(copy))] = f"x{i}"
        out.append((i, " ".join(copy), "en", "s1", None))
    out += [(200 + i, out[i][1], out[i][2], "s2", 1) for i in range(5)]  # exact copies
    out += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, "12 34", None, "s1", 5), (303, text("en", 30) + " " + PASSAGE, "en", "s3", 9), (304, "short leak " + " ".join(PASSAGE.split()[12:] + PASSAGE.split()[:12]), None, "s3", 9)]
    out += [(305, "\u4e2d\u6587 " * 40, None, "s1", 1), (306, "\u4e2d\u6587 " * 60 + "the house", None, "s1", 1)]  # no, and hardly any, letters of a learned language
    return out + [out[7], (None, text("de", 40), "de", "s0", 1)]


PASSAGE = " ".join(f"secret{i} item" for i in range(14))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (name, stage) in enumerate(p.STAGES):
        before = [tuple(x) for x in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"{k}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [tuple(x) for x in docs.collect()]
        if k < 4:
            assert docs.columns == p.COLUMNS
        if name == "language":
            want = [x for x in before if any(c.isalpha() for c in x[1] or "") and x[0] not in (305, 306)]
            assert Counter(after) == Counter(want)
        elif name == "near_duplicates":
            classes = {i: c for i, c, _ in brute([(x[0], x[1]) for x in before])}
            assert Counter(after) == Counter({x for x in before if x[0] is None or classes[x[0]] == x[0]})
        elif name == "decontamination":
            assert Counter(after) == Counter(x for x in before if "secret5" not in x[1])
        elif name == "mixing":
            keyed = p.keyed(spark.createDataFrame(before, SCHEMA))
            key = {x._key: (x.doc_id, x.text) for x in keyed.collect()}
            times = {key[x._key]: x.repeats for x in mixing.mix(keyed, id="_key").collect()}
            assert Counter(after) == Counter({x: times[x[:2]] for x in before if times[x[:2]]}) and max(times.values()) <= 2
            held = after
        else:
            check_shards(docs.collect(), len(held))
    again = p.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_an_id_or_have_none_are_judged_apart(spark, tmp_path):
    """Ids 1 and null stand for several texts: of each class one row stays, and only the rows that hold the passage go."""
    r = random.Random(4)
    a, b, c, d = (" ".join(f"{k}{r.randrange(500)}" for _ in range(40)) for k in "abcd")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, a), (7, a), (0, b), (1, b), (2, b), (None, c), (None, c), (None, d), (3, d), (4, "clean " + c[:50]), (4, PASSAGE), (None, PASSAGE + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = [(x.doc_id, x.text) for x in p.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert Counter(kept) == Counter([(1, a), (0, b), (None, c), (3, d), (4, "clean " + c[:50]), (4, PASSAGE)])
    clean = [(x.doc_id, x.text) for x in p.decontamination(spark, docs, str(tmp_path)).collect()]
    assert Counter(clean) == Counter(x for x in rows if PASSAGE not in x[1])
