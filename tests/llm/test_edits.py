import random

from parcelworks.llm import edits as E
from parcelworks.llm import tokens as T
from parcelworks.llm.common import table


def plain_tokenizer():
    """Counts take the special tokens' strings for ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(T.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


PLAIN = plain_tokenizer()


def check(tree, text):
    coder = T.encoder(T.tokenizer_path())
    assert tree.text() == text
    parts = [p for block, _ in tree.blocks for p in block]
    assert parts == coder.pretokens(text)
    assert tree.tokens == len(PLAIN.encode(text, add_special_tokens=False).ids) and tree.length == len(text)


def test_random_edits_equal_a_fresh_count():
    rng = random.Random(7)
    coder = T.encoder(T.tokenizer_path())
    pools = ["ab ", "ab  \n\t", "it's we'll I'd '", "aé1_.,  \n", "日a ½\x1c ", "xyz 123 "]
    for n in range(400):
        pool = rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 40, 400, 3000])))
        tree = E.TokenTree(text, coder)
        check(tree, text)
        for _ in range(6):
            if rng.random() < 0.3:  # as the next batch finds it
                tree = E.TokenTree(text, coder, tree.leaves())
                assert tree.encoded == 0
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 50]))
            new = "".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 8, 300])))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            check(tree, text)


def test_work_is_local():
    coder = T.encoder(T.tokenizer_path())
    text = "some words of a long text. " * 5000
    tree = E.TokenTree(text, coder)
    before = tree.encoded
    tree.replace(70_000, 70_004, "other")
    assert tree.encoded - before < 60
    check(tree, text[:70_000] + "other" + text[70_004:])


def test_two_batches_over_documents(spark):
    sf = "/root/testdata/sf0.01"
    size = lambda t: len(PLAIN.encode(t, add_special_tokens=False).ids)
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = E.op8(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_edits_1 for r in rows) and any(r.n_edits_2 for r in rows)
    for r in rows:
        text = texts[r.doc_id]
        first = E.SCRUB.sub("[gone]", text)
        second = E.PHONES.sub("[phone]", first)
        assert (r.n_chars, r.n_tokens, r.n_edits_1, r.n_edits_2) == (len(text), size(text), len(E.SCRUB.findall(text)), len(E.PHONES.findall(first)))
        assert (r.n_chars_after, r.n_tokens_after) == (len(second), size(second))
        assert (r.n_edits_1 or not r.n_reencoded_1) and (r.n_edits_2 or not r.n_reencoded_2)
    touched = [r for r in rows if r.n_edits_2]
    assert sum(r.n_reencoded_2 for r in touched) < 30 * sum(r.n_edits_2 for r in touched)
    assert sum(r.n_reencoded_2 for r in touched) < 0.3 * sum(r.n_pretokens for r in touched)


def test_given_edits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three", 0), (2, None, 0), (3, "", 0), (None, "x y", 0), (1, "one two three", 1), (4, "a b", 0)], "doc_id long, text string, start int")
    one = spark.createDataFrame([(1, 4, 7, "2"), (1, 0, 0, ">> "), (1, 13, 99, None), (3, 0, 0, "new text"), (9, 0, 1, "z")], "doc_id long, start int, stop int, replacement string")
    two = spark.createDataFrame([(1, 0, 3, None), (4, 3, 3, "c"), (None, 0, 1, "q")], "doc_id long, start int, stop int, replacement string")
    import parcelworks.llm.common as C

    for bound in (C.BROADCAST_BYTES, -1):
        monkeypatch.setattr(E, "broadcast_if_small", lambda frame, size, bound=bound: C.broadcast_if_small(frame, size, bound))
        got = sorted(((r.doc_id or 0, r.n_chars, r.n_chars_after, r.n_edits_1, r.n_edits_2) for r in E.counted(docs, one, two).collect()))
        assert got == [(0, 3, 3, 0, 0), (1, 13, 11, 3, 1), (1, 13, 11, 3, 1), (2, 0, 0, 0, 0), (3, 0, 8, 1, 0), (4, 3, 4, 0, 1)]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in E.counted(docs).collect())
    assert got == [(0, 2), (1, 3), (1, 3), (2, 0), (3, 0), (4, 2)]
    assert E.counted(docs.limit(0), one, E.BATCHES[0]).count() == 0


def test_leaves_round_trip():
    parts = ["a" * n for n in (1, 254, 255, 256, 70_000)]
    lengths, counts = E.unpacked(E.packed(parts, [1, 2, 300, 255, 9]))
    assert lengths.tolist() == [1, 254, 255, 256, 70_000] and counts.tolist() == [1, 2, 300, 255, 9]
    assert [len(x) for x in E.unpacked(E.packed([], []))] == [0, 0]
