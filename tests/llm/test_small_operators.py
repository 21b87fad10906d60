import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import storage
from framelake.llm import common, decontaminate, gif, html, language, mixing, sharding, toxicity, urlfilter

ODD_ROWS = [(1, None), (2, ""), (3, "   "), (4, "x"), (4, "x"), (None, "y z"), (5, "long " * 60000), (6, "e\u0301 \U0001f600 \u4e2d\u6587"), (7, "x")]


def odd_docs(spark, **more):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s1", 1, "a", 2.0, None) for k, (i, t) in enumerate(ODD_ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, score double, shard string")


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_and_handles_odd_rows(spark):
    r = random.Random(1)
    words = "the of and to in house river stone walk light green".split()
    rows, labels = [], []
    for i in range(800):
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(text) // 15)):
                text[r.randrange(len(text))] = r.choice(["idiot", "zorkish", "zorkly", "1diot"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, marks, may_learn=F.col("doc_id") < 600).collect()}
    assert len(got) == 800 and all(0 <= x.score <= 1 for x in got.values())
    held = [(got[i].predicted, bad) for i, bad in labels if i >= 600]
    assert sum(p == b for p, b in held) >= 0.97 * len(held)
    odd = toxicity.score(odd_docs(spark), marks, keep=("lang",)).collect()
    assert len(odd) == len(ODD_ROWS) and all(x.score is not None for x in odd)
    assert toxicity.score(docs.limit(0), marks.limit(0)).collect() == []


def plain_features(text, seed, you, learned, starts):
    """The features by their description, a word at a time; learned and starts: odds by folded word and by five-letter beginning."""
    low = text.lower()
    fold = "".join(toxicity.LEET.get(c, c) for c in low)
    words = [m.span() for m in re.finditer(r"[^\W_]+", fold)]
    n = max(len(words), 1)
    own = [fold[a:b] for a, b in words]
    odds, begin = [learned.get(w, 0) for w in own], [starts.get(w[:5], 0) for w in own]
    bad = [w in seed or o > 0 or s > 0 for w, o, s in zip(own, odds, begin, strict=True)]
    yous = [w in you for w in own]
    near = [b and any(yous[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, b in enumerate(bad)]
    caps = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
    chars = max(len(text), 1)
    return {
        "words": np.log1p(len(words)), "seed": sum(w in seed for w in own) / n, "learned": sum(o > 0 for o in odds) / n, "starts": sum(s > 0 for s in begin) / n,
        "weight": sum(max(a, b) for a, b in zip(odds, begin, strict=True)) / n, "window": max((sum(bad[i : i + toxicity.WINDOW]) for i in range(len(bad))), default=0), "near_you": sum(near) / n, "you": sum(yous) / n,
        "capitals": caps / chars, "all_caps": sum(x.isupper() for x in text.split()) / n if caps > 2 else 0, "punct": sum(c in ".,;:!?*%&#$" for c in text) / chars, "bangs": sum(c in "!?" for c in text) / chars,
        "obfuscated": sum(b and low[s:e] != fold[s:e] for b, (s, e) in zip(bad, words, strict=True)) / n, "word_length": sum(map(len, own)) / n,
    }


def test_toxicity_features_equal_plain_ones(spark):
    r = random.Random(7)
    pool = "idiot 1d10t scum house river you your YOU GARDEN zorkish zorkly stone! a,b (pig) what? lamp 42 $tupid light_walk".split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 70))) for _ in range(60)] + ["", " ", "!!", "IDIOT"]
    words = {"zorkish": 3.0, "lamp": 2.5}
    starts = {"zorkl": 2.25, "zorki": 4.0}
    keys = toxicity._hashes(sorted(words))
    by_hash = {int(toxicity._words([w]).hash[0]): v for w, v in words.items()}
    of_start = {int(toxicity._starts(toxicity._words([w]))[0]): v for w, v in starts.items()}
    start_keys = np.array(sorted(of_start), np.uint64)
    lexicon = (keys, np.array([by_hash[int(k)] for k in keys], np.float32), start_keys, np.array([of_start[int(k)] for k in start_keys], np.float32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in toxicity.features(docs, "doc_id", "text", lexicon).collect():
        want = plain_features(texts[x.doc_id], set(toxicity.SEED), set(toxicity.YOU), words, starts)
        assert all(abs(x[k] - v) < 1e-9 for k, v in want.items()), (texts[x.doc_id], {k: (x[k], v) for k, v in want.items() if abs(x[k] - v) >= 1e-9})


def test_toxicity_lexicon_equals_plain_counts(spark):
    r = random.Random(12)
    rows = [(" ".join(r.choice(f"w{i % 2}a w{i % 2}b both{r.randrange(3)}".split()) for _ in range(6)), i % 2) for i in range(40)]
    keys, odds, *_ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"), "text", "label")
    want = {}
    for w in {w for t, _ in rows for w in t.split()}:
        bad, good = (sum(w in t.split() for t, k in rows if k == of) for of in (1, 0))
        value = np.log((bad + 0.5) / 21) - np.log((good + 0.5) / 21)
        if bad >= 3 and bad > good and value > 2:
            want[int(toxicity._words([w]).hash[0])] = value
    assert dict(zip(keys.tolist(), np.round(odds, 4).tolist(), strict=True)) == pytest.approx(want, abs=1e-3) and want


def pooled(rows):
    """Pool adjacent violators over (x, label, weight), equal x first put together; gives (x, value)."""
    at = {}
    for x, y, w in rows:
        s, n = at.get(x, (0, 0))
        at[x] = (s + y * w, n + w)
    blocks = []
    for x in sorted(at):
        blocks.append([*at[x], [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_held_out_accuracy_on_given_tables(spark):
    """Documents that nothing was learned from: languages at sf0.01, toxicity at sf0.1 (whose labels are partly noise)."""
    out = language.op9_language(spark, "/root/testdata/sf0.01").where("held_out")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null and text rlike '[A-Za-z]{3}'").select("doc_id", "lang")
    right = out.join(known, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("r")).agg(F.avg("r"), F.count("r")).first()
    assert right[0] > 0.95 and right[1] > 150
    scored = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    caught, alone = (scored.where(F.col("toxic") == k).agg(F.avg((F.col("predicted") == k).cast("int"))).first()[0] for k in (1, 0))
    assert caught > 0.85 and alone > 0.98


def test_toxicity_of_rare_labels_and_calibration(spark, monkeypatch):
    """Six toxic labels of 3,000 are learned from a sample of 200, and the calibration is that of pooled adjacent violators."""
    r = random.Random(13)
    words = "the of and to in house river stone walk light green".split()
    docs = [(i, " ".join(["idiot"] * 3 * (i % 500 == 0) + [r.choice(words) for _ in range(20)])) for i in range(3000)]
    seen = []
    real = toxicity.IsotonicRegression.fit

    def watched(self, df):
        model = real(self, df)
        seen.append(([tuple(x) for x in df.select("_x", "_label", "_weight").collect()], model))
        return model

    monkeypatch.setattr(toxicity.IsotonicRegression, "fit", watched)
    d, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 500 == 0)) for i in range(3000)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score(d, marks, sample=200).collect()}
    assert [i for i in got if got[i]] == [i for i in range(0, 3000, 500)]
    rows, model = seen[0]
    want = pooled(rows)
    assert len(rows) < 60 and {w for _, y, w in rows if y == 0} != {1.0}
    have = dict(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
    assert all(abs(want[x] - v) < 1e-9 for x, v in have.items())
    one = toxicity.score(d, marks.where("toxic = 0"), sample=200)
    assert {(x.score, x.predicted) for x in one.collect()} == {(0.0, 0)}


# ---------------------------------------------------------------- URL filter


def test_rules_against_a_plain_version(spark):
    urls = ["http://a.example.net/en/1", "HTTPS://A.Example.NET/de/1?x", "http://example.net", "http://net/", "http://xnet/a", "http://b.org/fr/2#t", "http://org/fr/", "http://b.org/fr", "nourl", None, "", "x://", "http://user@h.net:80/p", "http://a.example.com/de/x", "http://ex\u00c4mple.com/de/", "//a/b", "a://b://c/d"]

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [rule for rule, _ in urlfilter.RULES for own, tail in [rule.split("/", 1)] if (host == own or host.endswith("." + own)) and path.startswith("/" + tail)]
        return host, path, max(fits, key=len, default=None)

    got = urlfilter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    assert len(got) == len(urls)
    says = dict(urlfilter.RULES)
    for x in got:
        assert (x.host, x.path, x.rule) == plain(urls[x.page_id])
        assert x.verdict == (says[x.rule] if x.rule else x.verdict) and x.verdict in ("allow", "block")


def test_templates_generalise_and_reject_by_purity(spark):
    rows = [(i, f"http://shop.test/item/{'abcdefghij'[i % 10]}{i}x/view") for i in range(60)] + [(100 + i, f"http://shop.test/spamword/{i}") for i in range(40)]
    rows += [(200 + i, f"http://mix.test/{'de' if i % 2 else 'en'}/{i}.html") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.page_id: x for x in urlfilter.judge(pages, rules=(), bad=F.col("_url").contains("spamword")).collect()}
    assert {got[i].verdict for i in range(60)} == {"allow"} and {got[100 + i].verdict for i in range(40)} == {"block"}
    assert {got[200 + i].template for i in range(40)} == {"/~/{n}.html"} or len({got[200 + i].template for i in range(40)}) == 1
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_tree_blocks_urls_without_a_rule_at_the_registered_settings(spark):
    """The rules label most of one host and a part of others; the rest of the first host is blocked by its purity."""
    rows = [(i, f"http://www.example.com/de/page/{i}") for i in range(200)] + [(1000 + i, f"http://www.example.com/shop/{'abc'[i % 3]}/{i}") for i in range(30)]
    rows += [(2000 + i, f"http://clean.example.org/{'fr' if i < 100 else 'it'}/page/{i}") for i in range(150)] + [(3000 + i, f"http://plain.test/page/{i}") for i in range(50)]
    got = {x.page_id: x for x in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[1000 + i].rule is None and got[1000 + i].verdict == "block" and got[1000 + i].purity >= 0.7 for i in range(30))
    assert all(got[k].verdict == "allow" for k in got if k >= 2000) and all(got[i].verdict == "block" for i in range(200))


def test_literal_marks_do_not_meet_generalised_segments(spark):
    rows = [(i, f"http://h.org/x/{i}") for i in range(40)] + [(100, "http://h.org/x/{n}"), (101, "http://h.org/~/1"), (102, "http://h.org/*/1"), (103, "http://h.org/%7E/1")]
    rows += [(200 + i, f"http://h.org/v{chr(97 + i % 26)}{chr(97 + i // 26)}/1") for i in range(60)]
    got = {x.page_id: x.template for x in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()}
    forms = {r[0]: r[1] for r in spark.createDataFrame([(m,) for m in urlfilter.MARKS], "m string").select("m", urlfilter.generalised(F.col("m"))).collect()}
    assert forms == {"~": "%7E", "*": "%2A", "{n}": "%7Bn}", "{date}": "%7Bdate}", "{hex}": "%7Bhex}", "{slug}": "%7Bslug}"}
    assert got[101] == got[103] and len(got) == len(rows)


def test_segments_beyond_the_fourth_are_judged(spark):
    """Paths that agree in four segments and part in the fifth get templates and verdicts of their own."""
    rows = [(i, f"http://h.org/a/b/c/d/{'bad' if i % 2 else 'good'}/e/x{chr(97 + i % 5)}") for i in range(80)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(), bad=F.col("_url").contains("/bad/")).collect()
    assert len(got) == 80 and {(x.page_id % 2, x.verdict) for x in got} == {(0, "allow"), (1, "block")}
    assert all(x.template.startswith("/a/b/c/d/" + ("bad" if x.page_id % 2 else "good")) for x in got)


def plain_templates(urls, least=10, variety=0.5, alike=0.7, weight=5.0):
    """The tree level by level over {(host, segments): (n, bad, labelled)}; gives template and purity of each."""
    state = {k: () for k in urls}
    for d in range(max((len(s) for _, s in urls), default=0)):
        groups = defaultdict(list)
        for k in urls:
            if len(k[1]) > d:
                groups[k[0], state[k]].append(k)
        for keys in groups.values():
            values = {k[1][d] for k in keys}
            total = sum(urls[k][0] for k in keys)
            wild = total >= least and len(values) > variety * total
            own = {k: "*" if wild else k[1][d] for k in keys}
            below = {k: k[1][d + 1] if len(k[1]) > d + 1 else "" for k in keys}
            count = lambda at, which=lambda k: True: sum(urls[k][at] for k in keys if which(k))  # noqa: E731, B023
            merged = set()
            if len(set(own.values())) > 1:
                pool = (count(1) + 0.5) / (count(2) + 1)
                for b in set(own.values()):
                    mine = lambda k, b=b: own[k] == b  # noqa: E731, B023
                    n = count(0, mine)
                    overlap = sum(min(count(0, lambda k, x=x: own[k] == b and below[k] == x) / n, count(0, lambda k, x=x: below[k] == x) / total) for x in {below[k] for k in keys if own[k] == b})  # noqa: B023
                    share = (count(1, mine) + 0.5) / (count(2, mine) + 1)
                    if overlap >= alike - 0.5 / n**0.5 and abs(share - pool) <= 2 * (pool * (1 - pool) / (count(2, mine) + 1)) ** 0.5:
                        merged.add(b)
            for k in keys:
                state[k] += ("~" if own[k] in merged else own[k],)
    sums = lambda match: [sum(v[i] for k, v in urls.items() if match(k)) for i in range(3)]
    _, bad, labelled = sums(lambda k: True)
    prior = bad / max(labelled, 1)
    out = {}
    for k in urls:
        hn, hb, hl = sums(lambda x: x[0] == k[0])  # noqa: B023
        n, b, m = sums(lambda x: x[0] == k[0] and state[x] == state[k])  # noqa: B023
        host = (hb + (weight + hn - hl) * prior) / (weight + hn)
        out[k] = ("".join("/" + x for x in state[k]), (b + (weight + n - m) * host) / (weight + n))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_trees_equal_plain_ones(spark, monkeypatch, seed):
    """Paths of up to five segments on hosts of all sizes; at seed 1 every table meets by a shuffle."""
    r = random.Random(seed)
    if seed == 1:
        monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    urls = {}
    for _ in range(400):
        host = r.choice(["a.test", "a.test", "b.test", "c.test", ""])
        path = tuple(r.choice([r.choice("xyz"), f"v{r.choice('abcdefghijklmnopq')}{r.choice('abcdefghij')}w", "en"]) for _ in range(r.choice([0, 1, 2, 2, 3, 5 - 2 * seed])))
        n, bad, labelled = urls.get((host, path), (0, 0, 0))
        known = r.random() < 0.6
        urls[host, path] = (n + 1, bad + (known and r.random() < (0.9 if "x" in path else 0.1)), labelled + known)
    table = spark.createDataFrame([(h, "".join("/" + x for x in s), *map(int, v)) for (h, s), v in urls.items()], "host string, form string, n long, bad long, labelled long")
    want = {(h, "".join("/" + x for x in s)): v for (h, s), v in plain_templates(urls).items()}
    got = {(x.host, x.form): (x.template, x.purity) for x in urlfilter.templates(table).collect()}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want) and len({v[0] for v in want.values()}) < len(want)


def test_rules_label_and_very_deep_paths_end(spark):
    """Unlabelled URLs of a host that is nearly all blocked are blocked, of one with few labels not; long unbranched paths cost no levels."""
    deep = "/a" * 3000
    rows = [(i, f"http://bad.test/spam/{i}") for i in range(60)] + [(60, "http://bad.test/other"), (61, f"http://far.test{deep}"), (62, f"http://two.test{deep}/x"), (63, f"http://two.test{deep}/y"), (64, f"http://two.test{deep}")]
    rows += [(100 + i, f"http://big.test/news/{i}") for i in range(60)] + [(200 + i, f"http://big.test/spam/{i}") for i in range(5)] + [(300 + i, f"http://good.test/{i}") for i in range(60)]
    rules = (("bad.test/spam/", "block"), ("big.test/spam/", "block"), ("good.test/", "allow"))
    got = {x.page_id: x for x in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[60].verdict == "block" and got[60].rule is None
    assert {got[100 + i].verdict for i in range(60)} == {"allow"} and {got[200 + i].verdict for i in range(5)} == {"block"}
    assert got[61].template == got[64].template == deep and got[61].verdict == "allow"
    assert {got[62].template, got[63].template} in ({deep + "/x", deep + "/y"}, {deep + "/~"})


# ---------------------------------------------------------------- sharding


def check_shards(out, n, shards=8):
    by = defaultdict(list)
    for x in out:
        by[x.shard].append(x.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_keep_copies_together(spark):
    r = random.Random(2)
    rows = [(i, f"text {i}") for i in range(500)] + [(1000 + i, f"copy {r.randrange(60)}") for i in range(300)] + [(3000 + i, "hot") for i in range(400)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.balanced_shards(docs).collect()
    check_shards(out, len(rows))
    at = {x.doc_id: x.shard for x in out}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(at[i])
    split = [t for t, s in groups.items() if len(set(s)) > 1]
    assert len(split) <= 6 and len(set(groups["hot"])) <= 6  # 400 rows need three shards of 150 or more
    again = sorted(map(tuple, sharding.balanced_shards(docs.repartition(3)).collect()))
    assert again == sorted(map(tuple, out))


def test_shards_of_odd_and_few_rows(spark):
    check_shards(sharding.balanced_shards(odd_docs(spark)).collect(), len(ODD_ROWS))
    got = {x.doc_id: x for x in sharding.balanced_shards(odd_docs(spark)).collect()}
    assert (got[1].size, got[1].text_crc32, got[2].size) == (1, 0, 1) and got[6].size == len(ODD_ROWS[7][1].encode()) + 1
    assert sharding.balanced_shards(odd_docs(spark).limit(0)).collect() == []
    every = spark.createDataFrame([(i, "same") for i in range(83)], "doc_id long, text string")
    check_shards(sharding.balanced_shards(every).collect(), 83)


def plain_propagation(groups, quota, tie, order):
    """Label propagation under quotas, a group and a wish at a time."""
    shards = range(len(quota))
    groups = {g: list(a) for g, a in groups.items()}
    while True:
        free = [max(0, q - sum(a[s] for a in groups.values())) for s, q in zip(shards, quota, strict=True)]
        asks = []
        for g, a in groups.items():
            liked = sorted((s for s in shards if a[s]), key=lambda s: (-a[s], tie[g, s], s))
            best = next((s for s in liked if free[s]), None)
            if best is not None:
                asks += [(best, -(a[best].bit_length() - 1), order(g, s), g, s, a[s]) for s in liked[liked.index(best) + 1 :]]
        if not asks:
            return groups
        for to, _, _, g, s, n in sorted(asks):
            give = min(n, free[to])
            free[to] -= give
            groups[g][s] -= give
            groups[g][to] += give


def test_propagation_equals_a_plain_one(spark):
    r = random.Random(21)
    start = {k: [r.choice([0, 0, 1, 2, 5]) for _ in range(4)] for k in range(120)}
    start = {g: a for g, a in start.items() if sum(a) > 1}
    total = sum(map(sum, start.values()))
    quota = [total // 4 + 12 + s for s in range(4)]
    table = spark.createDataFrame([(bytearray([g]), a) for g, a in start.items()], "g binary, a array<bigint>")
    tie = {(x.g[0], x.s): x.t for x in table.selectExpr("g", "explode(sequence(0, 3)) s").select("g", "s", F.pmod(F.xxhash64("g", "s"), F.lit(1 << 20)).alias("t")).collect()}
    hashes = {(x.g[0], x.s): x.h for x in table.selectExpr("g", "explode(sequence(0, 3)) s").select("g", "s", F.xxhash64("g", "s").alias("h")).collect()}
    got = {x.g[0]: list(x.a) for x in sharding.propagate(table, quota).collect()}
    want = plain_propagation(start, quota, tie, lambda g, s: hashes[g, s])
    assert got == want and all(sum(got[g]) == sum(a) for g, a in start.items())
    kept = lambda groups: sum(n * (n - 1) // 2 for a in groups.values() for n in a)  # noqa: E731  uncut pairs
    assert kept(got) > 2 * kept(start)


def test_places_of_large_groups_in_pieces(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(40)] + [(100 + i, "hot") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, sharding.balanced_shards(docs).collect()))
    monkeypatch.setattr(sharding, "HOT_ROWS", 8)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, sharding.balanced_shards(docs).collect())) == want


# ---------------------------------------------------------------- decontamination


def plain_tiling(doc, item, least):
    """Greedy string tiling by its definition."""
    in_doc, in_item, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in in_doc and b + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return out
        n, a, b = best
        in_doc.update(range(a, a + n))
        in_item.update(range(b, b + n))
        out.append(best)


def test_tiling_equals_its_definition(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(k, [r.choice(words) for _ in range(r.randint(1, 30))]) for k in range(12)]
    docs = []
    for i in range(60):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        for _, item in r.sample(items, 2):
            cut = r.randrange(len(item))
            text += item[cut:] + [r.choice(words)] * r.randrange(3) + item[:cut]  # in another order
        docs.append((i, text))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs] + [(100, None), (101, "")], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(50, None), (51, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.words for x in decontaminate.contaminated(d, b, coverage=0.4, seed=3).collect()}
    want = {(i, k): n for i, t in docs for k, item in items for n in [sum(x[0] for x in plain_tiling(t, item, min(3, len(item))))] if n >= 0.4 * len(item)}
    assert got == want and want


def test_decontamination_in_blocks_and_of_nothing(spark, monkeypatch):
    b = spark.createDataFrame([(k, " ".join(f"b{k}x{j}" for j in range(9))) for k in range(5)], "item_id long, text string")
    d = spark.createDataFrame([(k, f"start b{k}x0 " + " ".join(f"b{k}x{j}" for j in range(9)) + " end", 3) for k in range(5)], "doc_id long, text string, item_id int")
    whole = sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(d, b).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(d, b).collect()) == whole == [(k, k) for k in range(5)]
    assert decontaminate.contaminated(d, b.limit(0)).collect() == [] and decontaminate.contaminated(d.limit(0), b).collect() == []
    assert decontaminate.contaminated(odd_docs(spark), b).collect() == []


def test_short_items_match_as_a_whole(spark):
    b = spark.createDataFrame([(1, "What is love"), (2, "stone"), (3, " "), (4, "one two three four five")], "item_id long, text string")
    d = spark.createDataFrame([(1, "so what is love? they ask"), (2, "what is a stone"), (3, "love is what"), (4, "one two three four"), (5, "x one two three four five")], "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id, x.coverage) for x in decontaminate.contaminated(d, b).collect()) == [(1, 1, 1.0), (2, 2, 1.0), (5, 4, 1.0)]


def test_a_preamble_of_all_items_makes_no_pairs():
    """5,000 items begin with the same seven words; texts that hold only those look at no item."""
    items = [(k, "read the passage and answer the question " + " ".join(f"i{k}w{j}" for j in range(15))) for k in range(5000)]
    seeds = decontaminate.Seeds(items, 5, 0.5)
    texts = [f"read the passage and answer the question of {i} now" for i in range(400)] + [items[7][1]]
    start = time.time()
    assert [(t, i, c) for t, i, c, *_ in decontaminate._matches(texts, seeds, 0.5)] == [(400, 7, 1.0)]
    assert time.time() - start < 1


@pytest.mark.parametrize("coverage", [0.3, 0.5, 0.9, 1.0])
def test_probing_seeds_lose_no_pair(coverage):
    """Items that share passages and repeat words: the same pairs and tiles as from all seeds."""
    r = random.Random(int(coverage * 10))
    words = [f"w{i}" for i in range(12)]
    shared = [[r.choice(words) for _ in range(8)] for _ in range(3)]
    items = [(k, " ".join(r.choice(shared) + [r.choice(words) for _ in range(r.randint(0, 9))] + r.choice(shared)[: r.randint(0, 8)])) for k in range(30)]
    texts = [" ".join([r.choice(words) for _ in range(5)] + r.choice(shared) + items[r.randrange(30)][1].split()[r.randint(0, 9) :]) for _ in range(60)]
    some, every = decontaminate.Seeds(items, 4, coverage), decontaminate.Seeds(items, 4, 0.0)
    assert len(some.probe) < len(every.probe) == len(every.hash)
    got = decontaminate._matches(texts, some, coverage)
    assert got == decontaminate._matches(texts, every, coverage) and got


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("seed", range(40))
def test_fit_takes_the_best_reachable_sum(seed):
    r = np.random.default_rng(seed)
    lengths = np.unique(r.integers(1, (60, 300)[seed % 2], r.integers(1, 9))) * (1, 1, 6)[seed % 3]
    counts = r.integers(1, (5, 40)[seed % 2], len(lengths))
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + k * int(n) for s in sums for k in range(c + 1)}
    total = int((lengths * counts).sum())
    for budget in [*r.integers(0, total + 1, 40).tolist(), total, total - 1]:
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (lengths * take).sum() == max(s for s in sums if s <= budget)
    assert (mixing.fit(np.array([2, 38]), np.array([4, 3]), 78) * [2, 38]).sum() == 78


def test_fit_gives_back_what_the_first_choice_took(monkeypatch):
    """With almost nothing left free at first, and with counts too large to list all sums by hand."""
    monkeypatch.setattr(mixing, "FIT", 1)
    r = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(r.integers(20, 90, 4))
        counts = r.integers(1, 300, len(lengths))
        reach = np.zeros(int((lengths * counts).sum()) + 1, bool)
        reach[0] = True
        for n, c in zip(lengths, counts, strict=True):
            left = np.where(reach, 0, c + 1)
            for s in range(n, len(reach)):
                left[s] = min(left[s], left[s - n] + 1)
            reach = left <= c
        budget = int(r.integers(0, len(reach)))
        assert (mixing.fit(lengths, counts, budget) * lengths).sum() == np.flatnonzero(reach[: budget + 1])[-1]


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 50)), r.choice(["a", "b", "c", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in mixing.mix(docs.repartition(5)).collect())
    monkeypatch.setattr(mixing, "HOT_ROWS", 3)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in mixing.mix(docs).collect())
    size, taken, target = Counter(), Counter(), {}
    for x in out:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken in (0, x.size, 2 * x.size)
    weights, want, level = {"a": 5, "b": 2, "c": 1, None: 5}, {}, 0
    free, left = set(weights), 1.5 * sum(size.values())
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * size[s] + 1e-9}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        free -= over
    want |= {s: weights[s] * level for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in weights)


def test_mix_of_odd_rows(spark):
    out = mixing.mix(odd_docs(spark)).collect()
    assert len(out) == len(ODD_ROWS) and {x.size for x in out if x.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(odd_docs(spark).limit(0)).collect() == []


# ---------------------------------------------------------------- GIF


def test_gif_round_trips():
    r = random.Random(6)
    for payload in [bytes(64), bytes(range(256)) * 300, r.randbytes(64 * 2100), bytes(r.choice(b"ab") for _ in range(64 * 1500)), *(r.randbytes(64 * k) for k in range(1, 90))]:
        frames = list(gif.frames_of(gif.encode(payload)))
        assert b"".join(f[1] for f in frames) == payload and all(f[0] == 40 for f in frames)


def made_gif(frames, size=(4, 4), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of hand-made frames: (left, top, rows of indices, disposal, transparent index or None, delay, interlaced)."""
    import struct

    colours = b"".join(bytes(c) for c in palette)
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), colours]
    for left, top, rows, disposal, clear, delay, lace in frames:
        order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, len(rows), s)] if lace else range(len(rows))
        data = bytes(v for y in order for v in rows[y])
        stream = gif.lzw_encode(data)  # 8-bit samples
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0), struct.pack("<BHHHHB", 0x2C, left, top, len(rows[0]), len(rows), 0x40 if lace else 0), b"\x08"]
        out += [bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255))] + [b"\0"]
    return b"".join([*out, b";"])


def test_gif_disposal_transparency_and_interlace():
    red, green, blue, none = 0xFFFF0000, 0xFF00FF00, 0xFF0000FF, 0
    full = [[1] * 4] * 4
    shown = [f[2].copy() for f in gif.frames_of(made_gif([(0, 0, full, 1, None, 5, False), (1, 1, [[2, 0], [0, 2]], 2, 0, 5, False), (0, 0, [[3]], 3, None, 5, False), (3, 3, [[2]], 1, None, 5, False)]))]
    assert (shown[0] == red).all()
    assert shown[1][1, 1] == green and shown[1][1, 2] == red
    assert shown[2][1, 1] == none and shown[2][1, 2] == none and shown[2][0, 0] == blue  # the second frame's box was cleared
    assert shown[3][0, 0] == red and shown[3][3, 3] == green  # the third frame was put back
    rows = [[k % 4] * 4 for k in range(11)]
    frame = next(gif.frames_of(made_gif([(0, 0, rows, 1, None, 0, True)], (4, 11))))
    assert [int(v) for v in frame[2][:, 0]] == [[0xFF000000, red, green, blue][k % 4] for k in range(11)]


def test_gif_columns_of_odd_rows(spark):
    out = gif.decode(gif.to_gif(odd_docs(spark))).collect()
    assert len(out) == len(ODD_ROWS)
    for x in out:
        assert x.error is None and len(x.samples) == x.payload_bytes and x.samples[: x.n_bytes].decode() in [t or "" for _, t in ODD_ROWS]
        assert sum(sum(f.histogram) for f in x.frames) >= len(x.samples)
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(gif.encode(bytes(64))[:40]))], "id long, media binary")
    assert all(x.n_frames == 0 and x.error for x in gif.decode(bad).collect())
    assert gif.to_gif(odd_docs(spark).limit(0)).collect() == []


#: A GIF of 10 x 10 pixels made elsewhere: white, red, blue and black, 2-bit samples (fixed values).
FOREIGN = bytes.fromhex(
    "47494638396 10a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", "")
)
#: What it shows, a digit for each pixel's palette entry.
SHOWN = "1111122222 1111122222 1111122222 1110000222 1110000222 2220000111 2220000111 2222211111 2222211111 2222211111".split()


def plain_lzw(stream, least):
    """The codes of a stream read bit by bit, by the textbook's table."""
    bits = [b >> k & 1 for b in stream for k in range(8)]
    clear, table, width, before, out, at = 1 << least, {}, least + 1, None, [], 0
    while at + width <= len(bits):
        code = sum(b << k for k, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, before = {i: (i,) for i in range(clear)}, least + 1, None
            free = clear + 2
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else before + before[:1]
        out += entry
        if before is not None and free < 4096:
            table[free] = before + entry[:1]
            free += 1
        if free == 1 << width and width < 12:
            width += 1
        before = entry
    return out


def test_gif_of_foreign_bytes():
    frame = next(gif.frames_of(FOREIGN))
    palette = [0xFFFFFFFF, 0xFFFF0000, 0xFF0000FF, 0xFF000000]
    assert [[palette.index(int(v)) for v in row] for row in frame[2]] == [[int(c) for c in row] for row in SHOWN]
    assert gif.histogram(frame[2])[[0x3F, 0x30, 0x03]].tolist() == ["".join(SHOWN).count(c) for c in "012"]


@pytest.mark.parametrize("seed", range(8))
def test_lzw_equals_a_plain_decoder(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"ab\xff\0" if seed % 2 else range(256)) for _ in range(r.choice([1, 64, 5000, 40000])))
    stream = gif.lzw_encode(data)
    assert bytes(plain_lzw(stream, 8)) == data == gif.lzw_decode(stream, 8, len(data))


def test_gif_of_claims_and_broken_streams():
    """A huge canvas or frame, a stream that ends early, and one that would grow without end."""
    import struct

    good = gif.encode(bytes(range(64)) * 8)
    huge = good[:6] + struct.pack("<HH", 60000, 60000) + good[10:]
    at = good.index(b"\x2c\0\0\0\0")
    wide = good[: at + 5] + struct.pack("<HH", 60000, 60000) + good[at + 9 :]
    taller = good[: at + 7] + struct.pack("<H", 9) + good[at + 9 :]
    for broken in (huge, wide, taller):
        with pytest.raises(ValueError):
            list(gif.frames_of(broken))
    stream = gif.lzw_encode(bytes(4_000_000))
    assert gif.lzw_decode(stream, 8, 100) == bytes(100)


def test_gif_of_many_frames_is_bounded(spark, monkeypatch):
    """A small file may claim frames without end: they are an error before they are decoded; what fits is read."""
    one = gif.encode(bytes(64 * 1024))
    at = one.index(b"\x2c\0\0\0\0")
    frame = one[at : one.rindex(b"\x3b")]
    many = one[:at] + frame * 50 + b"\x3b"
    monkeypatch.setattr(gif, "SAMPLES", 30 * 64 * 1024)
    with pytest.raises(ValueError, match="together"):
        list(gif.frames_of(many))
    assert len(list(gif.frames_of(one[:at] + frame * 30 + b"\x3b"))) == 30
    monkeypatch.undo()
    rows = gif.decode(spark.createDataFrame([(1, bytearray(one[:at] + frame * 5000 + b"\x3b")), (2, bytearray(one))], "id long, media binary")).select("id", "error", "n_frames").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "the frames are too large together", 0), (2, None, 1)]


def test_mixing_search_beyond_its_bits_keeps_the_last_sum(monkeypatch):
    """Where the next search would not fit, the best sum of the one before is taken: never above the budget, never more than there is."""
    r = random.Random(3)
    lengths, counts = np.array(sorted(r.sample(range(5_000, 60_000), 40))) * 2 + 1, np.array([r.randint(1, 4) for _ in range(40)])
    budget = int((lengths * counts).sum()) // 2 + 1
    whole = mixing.fit(lengths, counts, budget)
    for bits in (1, 1 << 16, 1 << 21, 1 << 24):
        monkeypatch.setattr(mixing, "BITS", bits)
        some = mixing.fit(lengths, counts, budget)
        assert (some >= 0).all() and (some <= counts).all()
        assert budget - 3 * mixing.FIT - int(lengths.max()) <= int((some * lengths).sum()) <= int((whole * lengths).sum()) <= budget
    monkeypatch.setattr(mixing, "BITS", 1)
    assert mixing._search(lengths, counts, np.zeros(40, np.int64), budget) is None


# ---------------------------------------------------------------- repeated runs in tiling


def test_tiling_of_repeated_runs_takes_little_memory():
    import tracemalloc

    for phrase, item in ((["a"], 2_000), (["a", "b"], 2_001), (["a", "b", "c", "b"], 1_998)):
        texts = [" ".join((phrase * 100_000)[:100_000]), "x " + " ".join((phrase * item)[: item // 2]) + " y"]
        seeds = decontaminate.Seeds([(7, " ".join((phrase * item)[:item]))], 5, 0.5)
        tracemalloc.start()
        start = time.time()
        got = decontaminate._matches(texts, seeds, 0.5)
        assert time.time() - start < 60 and tracemalloc.get_traced_memory()[1] < 500_000_000
        tracemalloc.stop()
        assert got[0][:4] == (0, 7, 1.0, item) and got[0][4] == [{"doc_word": 0, "item_word": 0, "words": item}]
        assert [x[0] for x in got] == ([0, 1] if item // 2 * 2 == item else [0])


def test_tiling_equals_tiling_of_all_seed_pairs():
    """Texts of few words, so that seeds repeat: the longest unmarked match by trying every pair of places, again and again."""
    r = random.Random(11)
    for _ in range(150):
        doc, item = ([r.randrange(2) for _ in range(r.randint(3, 30))] for _ in range(2))
        width = 3
        names = {}
        seeds = lambda x: [names.setdefault(tuple(x[k : k + width]), len(names)) for k in range(len(x) - width + 1)]  # noqa: B023, E731
        d, i = seeds(doc), seeds(item)
        got = decontaminate.tiles(np.array(d), np.array([x if x in d else -1 for x in i]), width)
        in_doc, in_item, want = [False] * len(doc), [False] * len(item), []
        while True:
            best = (0, 0, 0)
            for a in range(len(doc)):
                for b in range(len(item)):
                    n = 0
                    while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not in_doc[a + n] and not in_item[b + n]:
                        n += 1
                    best = min(best, (-n, a, b))
            n, a, b = -best[0], *best[1:]
            if n < width:
                break
            want.append((a, b, n))
            in_doc[a : a + n], in_item[b : b + n] = [True] * n, [True] * n
        assert got == want


def test_benchmarks_are_cut_into_blocks_by_their_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1_000)
    for text in (",".join(f"w{k}" for k in range(400)), "\n".join(f"w{k}" for k in range(400)), "\u4e2d" * 6_400):
        items = spark.createDataFrame([(k, text) for k in range(10)], "item_id long, text string")
        sizes = [len(b) for b in decontaminate.blocks(items, "item_id", "text")]
        assert sizes == [3, 3, 3, 1]


# ---------------------------------------------------------------- HTML


LONG = "the cat of the house is in the garden and it was good " * 6


def test_html_blocks():
    page = f"<header><a href=/>Site</a></header><nav><ul><li>a</ul></nav><div class='cookie-notice'>{LONG}</div><main><h1>Title</h1><p>Short.<p>{LONG}<aside>{LONG}</aside><div class=ad>{LONG}</div><p>x &lt;b&gt; &amp;amp; &eacute;&nbsp;&nbsp;y<br>z</main><section id=comments><p>{LONG}</section><form><p>{LONG}</form><footer>{LONG}</footer><script>var t='</p>';</script><!-- <p>{LONG} -->"
    assert html.main_text(page) == "\n\n".join(["Title", "Short.", LONG.strip(), "x <b> &amp; \u00e9 y z"])


def test_html_without_article_uses_the_rules():
    links = "".join(f"<a href=/{i}>some link text here</a> " for i in range(9))
    page = f"<div>{links}</div><h2>Head</h2><div>{LONG}</div><p>A short one.</p><div>{LONG}</div><div>{links}</div><p>short end</p>"
    assert html.main_text(page) == "\n\n".join(["Head", LONG.strip(), "A short one.", LONG.strip()])


def test_html_odd_pages(spark):
    pages = [(1, None, None), (1, "u", ""), (2, "u", "<p"), (3, "u", "<!-- never closed"), (4, "u", "plain"), (5, "u", "<script>x"), (6, "u", "<article>" + "<div>" * 3000 + "deep"), (7, "u", "<a href='x>" + LONG), (8, "u", "<article><p>" + "w " * 50000)]
    out = {x.page_id: x for x in html.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")).collect()}
    assert len(out) == 8 and out[6].text == "deep" and out[8].n_chars == 99999 and all(x.n_chars == len(x.text) for x in out.values())
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("inner", ["<button>BAD</button>", "<select><option>BAD<option>BAD</select>", "<label>BAD <b>BAD</b></label>", "<dialog>BAD</dialog>", "<menu><li>BAD</menu>", '<span class="ad">BAD</span>', "<span class='share'>BAD <b>BAD</b></span>", "<a class=reply href=/>BAD</a>"])
def test_html_drops_controls_and_named_parts_only(inner):
    """Between and inside paragraphs; what stands around an inline part stays one block."""
    got = html.main_text(f"<article><p>{LONG}</p>{inner}<p>one {inner} two</p><p>{LONG}</p></article>")
    middle = ["one", "two"] if inner[:3] in ("<di", "<me") else ["one two"]
    assert got == "\n\n".join([LONG.strip(), *middle, LONG.strip()])


def test_html_of_languages_without_stop_words():
    ru = "\u042d\u0442\u043e \u0434\u043b\u0438\u043d\u043d\u044b\u0439 \u0442\u0435\u043a\u0441\u0442 \u043e \u0440\u0435\u043a\u0435. " * 12
    zh = "\u8fd9\u662f\u4e00\u4e2a\u5f88\u957f\u7684\u6bb5\u843d\u3002" * 12
    links = "".join(f"<a href=/{i}>some link text here</a> " for i in range(9))
    assert html.main_text(f"<nav>{links}</nav><div><p>{ru}</p><p>{zh}</p></div><div>{links}</div><footer>{ru}</footer>") == "\n\n".join([ru.strip(), zh])
    items = "apples, pears, oranges, lemons, " * 4
    assert html.main_text(f"<div>{links}</div><div>{LONG}</div><div>{items}</div><div>{LONG}</div>") == "\n\n".join([LONG.strip(), items.strip(), LONG.strip()])
    assert html.main_text(f"<nav>{links}</nav><p>Only a short one.</p><footer>x</footer>") == "Only a short one."
    assert html.main_text(f"<body class='has-sidebar search'><div class=with-sidebar><p>{LONG}</p></div><div class=sidebar>{LONG}</div>") == LONG.strip()
    assert html.main_text(f"<form><div><article><p>{LONG}</p><form>BAD</form></article>BAD</div></form>") == LONG.strip()


@pytest.mark.parametrize("name", ["layout sidebar-right", "two-col left-sidebar", "search-open", "elementor-widget-container", "widget_area", "pageMenu"])
def test_html_wrappers_with_suspect_names_keep_their_text(name):
    other = "A wall by the garden is in the light of the day and he had it with the water " * 6
    want = "\n\n".join([LONG.strip(), other.strip()])
    assert html.main_text(f"<body><div class='{name}'><article><p>{LONG}</p><p>{other}</p></article></div>") == want
    assert html.main_text(f"<body><div class='{name}'><p>{LONG}</p><p>{other}</p></div>") == want
    assert html.main_text(f"<body><div class='{name}'><article><p>{LONG}</p><p>{other}</p><div class=comments><p>{LONG}</p></div></article></div>") == want


def test_html_kit_names_and_sections_of_an_article_are_kept():
    parts = "".join(f'<div class="elementor-widget elementor-widget-text-editor"><div class="elementor-widget-container"><p>{LONG}</p></div></div>' for _ in range(5))
    assert html.main_text(f"<body>{parts}</body>") == "\n\n".join([LONG.strip()] * 5)
    got = html.main_text(f"<article><p>{LONG}</p><p class=social-policy>{LONG}</p><section class=related-work><p>{LONG}</p></section><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>")
    assert got == "\n\n".join([LONG.strip()] * 3 + ["Discussion", LONG.strip()])
    assert html.main_text(f"<div class=comments-open><article><p>{LONG}</p></article></div>") == LONG.strip()
    assert html.main_text(f"<form id=page><div><p>{LONG}</p><p>{LONG}</p></div><div class=comments>{LONG}</div></form>") == "\n\n".join([LONG.strip()] * 2)
    assert html.main_text(f"<article><p>{LONG}<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>TeX</annotation></math></p></article>") == LONG + "x+1"


@pytest.mark.parametrize("attributes", ["role=dialog", "role=alertdialog", "class=gdpr-box", "class=adsbygoogle", "class=userComments", "class=response", "class=discussion", "class=siteFooter", "class=site_footer", "class=share-buttons", "class=ad-slot", "id=cookieBanner"])
@pytest.mark.parametrize("inner", ["<p>BAD {}</p>", "<article><p>BAD {}</p></article>"])
def test_html_notices_comments_and_adverts_by_any_name(attributes, inner):
    bad, want = f"<div {attributes}>{inner.format(LONG)}</div>", "\n\n".join([LONG.strip()] * 2)
    assert html.main_text(f"<article><p>{LONG}</p><p>{LONG}</p></article>{bad}") == want
    assert html.main_text(f"<article><p>{LONG}</p>{bad}<p>{LONG}</p></article>") == want
    assert html.main_text(f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{bad}") == "\n\n".join([LONG.strip()] * 3)


def test_html_comments_longer_than_the_article_go():
    assert html.main_text(f"<div class=post><p>{LONG}</p></div><div class=comments>" + f"<p>{LONG}</p>" * 5 + "</div>") == LONG.strip()


def test_html_takes_time_in_proportion():
    start = time.time()
    html.main_text("<div>" * 8000 + "x" + "</i></b></section></div>" * 8000)
    html.main_text("<article>" + "<p>short one</p>" * 10000 + "</article>")
    html.main_text("<form><article>" * 5000 + "<a>" * 5000 + "<p>" * 5000)
    assert time.time() - start < 2.5


def plain_labels(blocks):
    """The two passes, written out from their description: each undecided block looks outwards."""
    stats = []
    for text, *_ in blocks:
        words = re.findall(r"\w+", text.lower())
        stats.append((len(words), sum(w in html.STOP_WORDS for w in words)))
    judged = [s for s, b in zip(stats, blocks, strict=True) if not b[2] and b[4] <= 0.4]
    known = sum(s for _, s in judged) >= 0.05 * sum(n for n, _ in judged)
    first = []
    for (n, stops), (text, _, bad, inside, links) in zip(stats, blocks, strict=True):
        share = stops / max(n, 1)
        if bad or links > 0.4:
            first.append("bad")
        elif len(text) < 70:
            first.append("bad" if links and not inside else "short")
        elif not known or share >= 0.25:
            first.append("good" if len(text) > 200 else "near")
        else:
            first.append("near" if share >= 0.1 or inside or not links else "bad")
    out = []
    for i, (_, tag, _, inside, _) in enumerate(blocks):
        if first[i] in ("good", "bad"):
            out.append(first[i] == "good")
            continue
        sides = []
        for step in (-1, 1):
            j, gap = i + step, 0
            while 0 <= j < len(blocks) and first[j] not in ("good", "bad"):
                gap += len(blocks[j][0])
                j += step
            if not 0 <= j < len(blocks):
                continue
            silent = inside and (blocks[j][2] or not blocks[j][3]) or "good" not in first and blocks[j][2]
            if not silent:
                sides.append((first[j], gap))
        says = {s for s, _ in sides}
        if not sides:
            out.append(inside or first[i] == "near" or "good" not in first)
        elif len(says) == 1:
            out.append(says == {"good"} or first[i] == "near" and inside)
        elif tag.startswith("h"):
            out.append(sides[1][0] == "good")
        else:
            out.append(min(sides, key=lambda s: s[1])[0] == "good" or first[i] == "near" and inside)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_html_labels_equal_plain_ones(seed):
    r = random.Random(seed)
    words = "the of and house river stone garden walk lamp roof".split()[r.choice([0, 0, 3]) :]
    blocks = [(" ".join(r.choice(words) for _ in range(r.choice([2, 8, 20, 60]))), r.choice(["p", "p", "h2", "div"]), r.random() < 0.15, r.random() < 0.4, r.choice([0, 0, 0, 0.1, 0.9])) for _ in range(r.randint(1, 25))]
    assert html.labels_of(blocks) == plain_labels(blocks)


# ---------------------------------------------------------------- language


def plain_viterbi(scores, switch):
    n, k = scores.shape
    best, back = scores[0].astype(float).copy(), []
    for t in range(1, n):
        step = best[None, :] - switch * (1 - np.eye(k))
        back.append(step.argmax(1))
        best = step.max(1) + scores[t]
    return best.max()


def test_words_of_the_last_planes():
    assert len(common.Words(["a \U00030001\U00030002 b", "\U000323af"]).hash) == 4


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_path(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, 40, 12)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = -r.exponential(4, (bounds[-1], 3)).astype(np.float32)
    path = language.viterbi(scores, bounds, 15.0)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e > s:
            own = scores[np.arange(s, e), path[s:e]].sum() - 15.0 * (np.diff(path[s:e]) != 0).sum()
            assert abs(own - plain_viterbi(scores[s:e], 15.0)) < 1e-3


def test_languages_spans_and_odd_rows(spark):
    en, de, ru = "the house of the river and this was that with", "der hund und das haus ist nicht auf dem berg", "\u044d\u0442\u043e \u043d\u0435 \u0434\u043e\u043c \u0438 \u043d\u0435 \u0440\u0435\u043a\u0430"
    r = random.Random(8)
    mixed_up = lambda t: " ".join(r.choice(t.split()) for _ in range(30))
    train = [(i, mixed_up((en, de, ru)[i % 3]), ("en", "de", "ru")[i % 3]) for i in range(90)]
    model = language.learn(spark.createDataFrame([*train, (None, None, "en"), (91, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    rows = [*ODD_ROWS, (10, mixed_up(en)), (11, mixed_up(de)), (12, mixed_up(ru)), (13, mixed_up(en) + " " + " ".join([mixed_up(de)] * 2)), (14, "1234 !?"), (15, "\u4e2d\u6587"), (16, "\u0301\u0302 \u0303"), (17, "\U00030001\U00030002")]
    out = {x.doc_id: x for x in language.identify(spark.createDataFrame([(*x, "u") for x in rows], "doc_id long, text string, spans string"), model).collect()}
    assert [out[i].lang_pred for i in (10, 11, 12, 13)] == ["en", "de", "ru", "de"]
    assert [s.lang for s in out[13].spans] == ["en", "de"] and 0.5 < out[13].score < 0.8
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 14, 16))
    assert all(out[i].lang_pred in model.languages and out[i].score == 0 for i in (15, 17))
    few = language.learn(spark.createDataFrame([*train, *((1000 + i, mixed_up(en), "en") for i in range(400)), (2000, "ein kleiner satz", "nds")], "doc_id long, text string, lang string"), sample=20)
    assert few.languages == ["de", "en", "nds", "ru"]  # a rare language is learned beside frequent ones
    nothing = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {x.lang_pred for x in language.identify(odd_docs(spark), nothing).collect()} == {"und"}
