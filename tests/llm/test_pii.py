import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from test_small_operators import ODD_ROWS, odd_docs

from framelake.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_fixed(text):
    """The fixed patterns as they are defined."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else False, 16 <= len(digits) <= 19 and total % 10 == 0, 8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.windows(["house", "river", "stone", "with", "größe"], 800), steps=100)


def test_fixed_patterns_equal_their_definition():
    r = random.Random(4)
    for letters in ("@@..1234567890  --++()ab%_é", "12 -+.", "a@.b-", "0.25"):
        for _ in range(3000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
            assert pii.fixed_spans(text) == plain_fixed(text)


def test_long_texts_take_linear_time(field):
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1 " * 100_000, "+1" * 100_000, "a@a" * 50_000, "1." * 100_000, "[dot]" * 50_000 + "@a.b"):
        pii.spans_of([text], field)


def test_best_is_the_highest_of_all_segmentations():
    r = random.Random(2)
    for _ in range(200):
        found = [(s, s + r.randint(1, 5), r.randrange(4), float(r.randint(-2, 9))) for s in (r.randrange(12) for _ in range(7))]
        chosen = pii.best(found)
        sums = [sum(x[3] for x in part) for n in range(8) for part in itertools.combinations(found, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(part, 2))]
        assert sum(x[3] for x in chosen) == max(sums)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(chosen))


def test_learning_raises_the_likelihood_of_the_segmentations():
    """The likelihood by listing every segmentation is higher for the learned weights than for others near them."""
    examples = [("call +1 (555) 123-4567 or 12345678", [(3, 5, 22)]), ("x 10.0.0.1", [(1, 2, 10)]), ("at 4111 1111 1111 1111", [(2, 3, 22)]), ("id 1234567 1234567", [])]
    learned = pii.fit(examples, steps=400, rate=0.05, ridge=0.01)

    def value(field):
        text, start, end, kind, score = pii.scores(*pii.segments([t for t, _ in examples]), field)
        out = -0.005 * len(examples) * ((field.numbers**2).sum() + (field.mails**2).sum())
        for t, (_, gold) in enumerate(examples):
            own = [(s, e, k, v) for x, s, e, k, v in zip(text, start, end, kind, score, strict=True) if x == t]
            # sums over all segmentations: from each place, go on or take a segment
            ways = {}
            for p in range(len(examples[t][0]), -1, -1):
                ways[p] = ways.get(p + 1, 1.0) + sum(np.exp(v) * ways[e] for s, e, _, v in own if s == p)
            out += sum(v for s, e, k, v in own if (k, s, e) in gold) - np.log(ways[0])
        return out

    r = np.random.default_rng(1)
    top = value(learned)
    for _ in range(20):
        other = pii.Field(learned.numbers + r.normal(0, 0.3, learned.numbers.shape), learned.mails)
        assert value(other) < top


def test_field_finds_held_out_forms_and_leaves_look_alikes(field):
    held = pii.windows(["wall", "light", "sommer", "blé"], 600, seed=9)
    found = hit = missed = wrong = 0
    for (text, gold), spans in zip(held, pii.spans_of([t for t, _ in held], field), strict=True):
        fixed = plain_fixed(text)
        free = [g for g in gold if not any(s < g[2] and g[1] < e for k, s, e in fixed)]
        added = [x[:3] for x in spans if not x[3]]
        assert [x[:3] for x in spans if x[3]] == fixed
        assert not any(s < e2 and s2 < e for _, s, e in added for _, s2, e2 in fixed)
        found += len(free)
        hit += sum(g in added for g in free)
        missed += sum(g not in added for g in free)
        wrong += sum(a not in gold for a in added)
    assert hit >= 0.95 * found and wrong <= 0.05 * found
    (spans,) = pii.spans_of(["+1 (663) 555-6869 4465758382889437 and ann [at] example [dot] com"], field)
    assert [x[:3] for x in spans] == [(0, 39, 65), (2, 18, 34), (3, 0, 17)]


def test_query_and_odd_rows(spark, field, tmp_path):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de, card 4111 1111 1111 1111, +49 30 1234567 from 10.0.0.256 or 10.0.0.25"), (3, "x"), (None, "1.2.3.4"), (4, "é a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_text = {(x.doc_id, x.spans): x for x in got}
    text = rows[2][1]
    fixed = plain_fixed(text)
    written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in fixed)
    row = by_text[3, written]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == x for k, *_ in fixed) for x in range(4))
    assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    assert by_text[4, "email:2:7"].n_email == 1 and by_text[None, "ip:0:7"].n_ip == 1 and by_text[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(pii.find(odd_docs(spark), field).collect()) == len(ODD_ROWS)
    assert pii.find(odd_docs(spark).limit(0), pii.learn(odd_docs(spark).limit(0), examples=50)).collect() == []
