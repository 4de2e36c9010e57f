"""Tokenizer alignment against a brute-force version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearth.llm import alignment
from hearth.llm.byte_bpe import ByteBpe, byte_letters
from hearth.llm.queries import op11_tokenizer_alignment

EXTRA = [
    (20, "special <|endoftext|> strings  and\n\nlines\t\twith   runs ", "en", "s", 1),
    (21, " leads and trails ", "en", "s", 1),
    (22, "▁marker inside", "en", "s", 1),
    (23, "it's 3.14 of naïve café, 東京タワー \U0001f680\U0001f468‍\U0001f469", "en", "s", 1),
    (24, "\x1c\x1d odd spaces　and\u0085more ᠎ x", "en", "s", 1),
    (25, "\0nul", "en", "s", 1),
    (26, " ", "en", "s", 1),
]


def brute(texts):
    """The columns of every text, in order."""
    import sentencepiece

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: n for n, c in byte_letters().items()}
    rows, pairs = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, 0, ""))
            pairs.append([])
            continue
        spans = []
        for side in (bytes_a, bytes_b):
            at, found = 0, []
            for x in side:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        links, first = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][first][1] <= low:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][0] < high:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for e in ends:
            left, right = [], []
            while i < len(ids_a) and spans[0][i][1] <= e:
                left.append(str(ids_a[i]))
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= e:
                right.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        rows.append((len(ids_a), len(ids_b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.append(links)
    count = Counter(p for links in pairs for p in set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(*r[:3], len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), r[3]) for r, links in zip(rows, pairs, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(found, rows):
    expected = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)
    assert sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in found.collect()), key=str) == expected


@pytest.mark.parametrize("bundle", [2_000_000, 1])
def test_awkward_rows_equal_brute_force(spark, documents, monkeypatch, bundle):
    from tests.llm.conftest import AWKWARD

    monkeypatch.setattr(alignment, "BUNDLE_PAIRS", bundle)
    monkeypatch.setattr(alignment, "GROUP_BYTES", 100 if bundle == 1 else 1 << 20)
    rows = [*AWKWARD, *EXTRA]
    check(alignment.align(documents(rows, clash=["bundle", "pair", "n_a", "docs", "id"])), rows)


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(op11_tokenizer_alignment(spark, folder), rows)


def test_empty_table(spark, documents):
    assert alignment.align(documents([])).count() == 0


def test_ids_equal_the_tokenizers_library():
    from tests.llm.conftest import AWKWARD

    path = public_tokenizers.path("byte_bpe_50k.json")
    pick = random.Random(5)
    parts = ["word", " ", "  ", "\n", "\t", "'s", "3", ".", "é", " ", "\x1c", "᠎", "<|endoftext|>", "　", "中", "\x85", "​", "\0", " " * 5000, "\n" * 4100]
    texts = [r[1] or "" for r in [*AWKWARD, *EXTRA]] + ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(4000)]
    for plain in (False, True):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = plain
        own = ByteBpe(path, plain_specials=plain)
        for text in texts:
            assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_starts_inside_the_other_side_are_found_once():
    import numpy as np

    a, b = alignment.overlaps(np.array([0, 0, 1]), np.array([0, 3, 6]), np.array([0, 0, 0, 1]), np.array([0, 1, 4, 6]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)]
