"""Alignment of two tokenizers: the query against brute force with the tokenizers' own libraries, bitmaps over several blocks, edges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from trackframe.llm import alignment
from trackframe.llm.queries import op13_tokenizer_alignment

RANKS, PIECES, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def unbyte():
    """Characters of the byte-level spelling back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        byte = unbyte()
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def document(self, text):
        """(a ids, b ids, groups, links)."""
        none = ([], [], "", [])
        if not text:
            return none
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        pieces = [[self.a_bytes.get(i, b"") for i in a], [self.b_bytes(i) for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return none
        spans = []
        for p in pieces:
            at, out = 0, []
            for x in p:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, links, own = [], [], ([], [])
        tokens = sorted([(e, s, 0, i) for i, (s, e) in zip(a, spans[0], strict=True)] + [(e, s, 1, i) for i, (s, e) in zip(b, spans[1], strict=True)], key=lambda x: (x[0], x[2]))
        for e, s, which, i in tokens:
            own[which].append((s, e, i))
            if which and e in common:  # of two tokens that end here the second's comes last
                groups.append("|".join(",".join(str(x[2]) for x in side) for side in own))
                links += [(x[2], y[2]) for x in own[0] for y in own[1] if x[0] < y[1] and y[0] < x[1]]
                own = ([], [])
        return a, b, ";".join(groups), links

    def rows(self, texts):
        docs = [self.document(t) for t in texts]
        counts = Counter(pair for *_, links in docs for pair in set(links))
        most = defaultdict(int)
        for (i, _), n in counts.items():
            most[i] = max(most[i], n)
        for a, b, groups, links in docs:
            sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            yield len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip((r.doc_id for r in docs), Brute().rows([r.text for r in docs]), strict=True))
    rows = op13_tokenizer_alignment(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n", "\t", "\x00", "a\u00a0b \u00a0 c", "▁", "a ▁b", "<|endoftext|>", "<s> x </s> <unk> <0x41>", "ﬁ Ａ é é", "你好 世界", "한국어 텍스트 " * 5, "𝒳😀 😀", "don't we'll I'M", "x" * 5000,
    "1234567 " * 50, "a\r\nb\x0b c\x1c d\x85 e", "\u2028 \u3000 x", "ñ́ " * 20, "a" + " " * 300 + "b", "\ufeffbom", "end\n\n\n",
]


def test_odd_texts(spark):
    rnd = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "漢", "1", ".", "'s", "\t", "\u00a0", "😀", "<s>", "B"]
    texts = ODD + ["".join(rnd.choices(parts, [6, 6, 9, 1, 1, 1, 0.1, 1, 1, 1, 1, 0.5, 0.3, 1, 0.3, 2], k=rnd.randint(1, 25))) for _ in range(300)]
    docs = [*enumerate(texts), (None, "the end"), (None, None), (4, "a"), (4, "a")]
    frame = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id long, text string, block int, place string")
    want = sorted(str((i, *r)) for (i, _), r in zip(docs, Brute().rows([t for _, t in docs]), strict=True))
    assert sorted(str(tuple(r)) for r in alignment.align(frame, RANKS, PATTERN, PIECES).collect()) == want
    assert alignment.align(frame.limit(0), RANKS, PATTERN, PIECES).count() == 0


def test_bitmaps_of_dense_and_sparse_pairs_over_several_blocks(spark):
    rnd = random.Random(5)
    words = ["alignment", "tokenizer", "über", "thhashen", "repeat"]
    texts = [" ".join(rnd.choices(words, [9, 2, 1, 0.05, 20], k=rnd.choice([1, 3, 40, 1000] if i < 20 else [1, 3, 10]))) for i in range(6000)]
    brute = Brute()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id string, text string").coalesce(1)
    written = alignment.postings(frame, RANKS, PATTERN, PIECES)
    assert written.select("block").distinct().count() == 3
    counts = {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in alignment.pair_counts(written).collect()}
    docs = [brute.document(t) for t in texts]
    plain, links = Counter(p for *_, x in docs for p in set(x)), Counter(p for *_, x in docs for p in x)
    most = defaultdict(int)
    for (i, _), n in plain.items():
        most[i] = max(most[i], n)
    assert counts == {p: (n, links[p], n == most[p[0]]) for p, n in plain.items()}
    got = {r.id: tuple(r)[1:] for r in alignment.align(frame, RANKS, PATTERN, PIECES).collect()}
    assert got == {str(i): r for i, r in enumerate(brute.rows(texts))}


def test_compressed_bitmaps():
    rng = np.random.default_rng(6)
    entries = np.unique(np.concatenate([rng.integers(0, 5, 900) * alignment.BLOCK + rng.integers(0, 900, 900), 3 * alignment.BLOCK + np.arange(alignment.BLOCK), [9 * alignment.BLOCK]]))
    pair, place = np.divmod(entries, alignment.BLOCK)
    which, bits = alignment._bitmaps(pair, place)
    for p, x in zip(which.tolist(), bits.to_pylist(), strict=True):
        got = np.frombuffer(x, "<u2") if len(x) < alignment.BLOCK // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8)))
        assert got.tolist() == place[pair == p].tolist()
        assert len(x) <= alignment.BLOCK // 8
