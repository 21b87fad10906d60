import hashlib
import random

import numpy as np
import pytest
from test_small_operators import ODD_ROWS, odd_docs

from framelake.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.files())


def plain_tokens(pair, text):
    """Both tokenizers over the whole text at once."""
    if not text:
        return [], []
    a, b, want = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text), (" " + text).encode()
    same = b"".join(pair.a_bytes[k] for k in a) == want == b"".join(pair.b_bytes[k] for k in b)
    return (a, b) if same else ([], [])


def plain_alignment(pair, a, b):
    """Groups and links by comparing every token of one with every token of the other."""
    ends = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, own = 0, []
        for k in ids:
            own.append((at, at + len(table[k])))
            at += len(table[k])
        ends.append(own)
    common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
    groups = [tuple([k for k, (s, e) in zip(ids, own, strict=True) if low <= s and e <= high] for ids, own in ((a, ends[0]), (b, ends[1]))) for low, high in zip([0, *common], common, strict=False)]
    links = [(x, y) for x, (s, e) in zip(a, ends[0], strict=True) for y, (p, q) in zip(b, ends[1], strict=True) if max(s, p) < min(e, q)]
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return groups, links, hashlib.sha256(text.encode()).hexdigest() if a else ""


def odd_texts():
    r = random.Random(1)
    letters = [*"ab cd  \n\t éñ中\U0001f600▁.,12'  　\x1c​́ﬁ\x00", "<|endoftext|>", "<s>", " 's", "don't", "క్", "\U0001f469‍\U0001f33e"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["The café in Straße 12 is open.\nIt is good", "a", " ", "  a  ", "\n", "x▁y", "<|endoftext|> </s>"]


def test_words_encoded_apart_equal_whole_texts(pair):
    texts = odd_texts()
    own = alignment.Encoder(pair)
    for part in (texts[:50], texts):  # the second time with words that are known
        for text, a, b in zip(part, *own.encode(part)[:2], strict=True):
            assert tuple(np.frombuffer(x, alignment.PACKED).tolist() for x in (a, b)) == plain_tokens(pair, text)
    assert own.encode([""]) == ([b""], [b""], [""])


def test_spans_refined_by_bytes_give_the_decoded_ends(pair):
    words = sorted({w for t in odd_texts() if t for w in alignment.words_of(t)})
    a, b, odd = pair.encode(words)
    assert odd.any() and not odd.all()
    for tokens, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        for i in np.flatnonzero(~odd):
            s, e = tokens.bounds[i : i + 2]
            assert tokens.end[s:e].tolist() == np.cumsum([len(table[k]) for k in tokens.ids[s:e]]).tolist()


def expected(pair, texts):
    made = [plain_tokens(pair, t) for t in texts]
    aligned = [plain_alignment(pair, *x) for x in made]
    counts, best = {}, {}
    for _, links, _ in aligned:
        for x in links:
            counts[x] = counts.get(x, 0) + 1
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for (a, b), (groups, links, digest) in zip(made, aligned, strict=True)]


@pytest.mark.parametrize("most", [alignment.BLOCK, 150, 1])
def test_query_equals_its_definition_in_any_number_of_blocks(spark, pair, most):
    texts = odd_texts()[-120 if most > 1 else -12 :]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _id string").repartition(3)
    got = {x.doc_id: tuple(x)[1:] for x in alignment.align(docs, *alignment.files(), most=most).collect()}
    assert [got[i] for i in range(len(texts))] == expected(pair, texts)


def test_odd_rows_and_the_groups_themselves(spark, pair):
    rows = alignment.align(odd_docs(spark), *alignment.files()).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(x.n_a == 0 and x.n_b == 0 and x.groups_sha256 == "" for x in rows if x.doc_id in (1, 2))
    assert len({tuple(x) for x in rows if x.doc_id == 4}) == 1
    assert alignment.align(odd_docs(spark).limit(0), *alignment.files()).collect() == []
    docs = spark.createDataFrame([(1, "The café \U0001f469‍\U0001f33e"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x.groups for x in alignment.groups(alignment.encode(docs, *alignment.files()), pair.a_size, pair.b_size).collect()}
    want = plain_alignment(pair, *plain_tokens(pair, "The café \U0001f469‍\U0001f33e"))[0]
    assert [(g.a, g.b) for g in got[1]] == want and got[1][-1].end == len(" The café \U0001f469‍\U0001f33e".encode()) and got[2] == []
