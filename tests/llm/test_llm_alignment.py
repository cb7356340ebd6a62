import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pytest

from cartoloom.llm.queries import tokenizer_file
from cartoloom.llm.token_alignment import align_tokens, byte_level_entries

SCHEMA = "doc_id long, text string, lang string, n_a int, slice long, stripe int, kind string"
LONG = "un été à Köln: 価格 12,5 € — naïve façade; the price of the house is 300. " * 900


def texts():
    out = [
        "The quick brown fox jumps over the lazy dog.", "the fox, the dog; the house", "Über allen Gipfeln ist Ruh'", "価格は百円です", "a  b   c", " leading", "trailing ",
        "tab\there\nand lines\r\n\r\nmore", "<|endoftext|> is plain text here <s> </s> <unk> <0x41>", "▁ marks", " no-break wide", "😀😃 emoji \U0001f468‍\U0001f469", "", None, " ", "\x00\x01 control",
        LONG, "don't can't they've we'll I'm", "x" * 3000, "the fox, the dog; the house",
    ]
    return [(k, t, "en", 1, 2, 3, "x") for k, t in enumerate(out)] + [(None, "null id", "en", 1, 2, 3, "x"), (3, "repeated id", "en", 1, 2, 3, "x"), (3, "repeated id", "en", 1, 2, 3, "x")]


def plain(rows):
    """Token by token, with the libraries and lists."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    entries = byte_level_entries(path)
    left = Tokenizer.from_file(path)
    left.encode_special_tokens = True
    right = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    made, pairs = [], Counter()
    for row in rows:
        text = row[1] or ""
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        bytes_a = [entries[i] for i in a]
        bytes_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            made.append((row[0], None))
            continue
        ends_a, ends_b = (list(accumulate(map(len, own))) for own in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        sides = [[[] for _ in common], [[] for _ in common]]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for x, end in zip(ids, ends, strict=True):
                sides[side][bisect_left(common, end)].append(str(x))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = ends_a[i], ends_b[j]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        pairs.update(links)
        made.append((row[0], (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for own, got in made:
        if got is None:
            out.append((own, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = got
            out.append((own, n_a, n_b, n_groups, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), sha))
    return sorted(map(repr, out))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = align_tokens(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), **options)
    assert out.columns == COLUMNS
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"stripe": 7, "group": 40, "fan": 2, "slice_bytes": 300}])
def test_equals_token_by_token(spark, options):
    want = plain(texts())
    assert sum("''" in w for w in want) >= 3 and sum("''" not in w for w in want) >= 14
    assert got(spark, texts(), **options) == want


def test_no_texts_and_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, "en", 1, 2, 3, "x"), (2, "", "en", 1, 2, 3, "x")]) == [repr((k, 0, 0, 0, 0, 0, 0, "")) for k in (1, 2)]


def test_registered_query_equals_token_by_token(spark):
    from cartoloom.llm.queries import op12_alignment

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in op12_alignment(spark, "/root/testdata/sf0.001").select(COLUMNS).collect()) == plain(rows)
