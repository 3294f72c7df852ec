"""Piece counts against greedy longest match that builds the pieces."""

import base64
import random
import re

import public_tokenizers

from trackframe.llm import wordpieces
from trackframe.llm.queries import op10_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word, first, rest):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n, pieces = end, n + 1, rest
    return n


def test_random_vocabularies():
    rnd = random.Random(2)
    for _ in range(150):
        make = lambda k: {"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(k)}
        first, rest = make(rnd.randint(0, 9)), make(rnd.randint(0, 12))
        automaton = wordpieces.Automaton(first, rest)
        for _ in range(60):
            word = "".join(rnd.choices("abcd", [5, 5, 5, 1], k=rnd.randint(0, 14)))
            assert automaton.count(word) == greedy(word, first, rest), (word, first, rest)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op10_token_counts(spark, sf).collect()}
    with open(PATH, "rb") as f:
        tokens = [base64.b64decode(x.split()[0]).decode("latin-1") for x in f]
    first, rest = {t[1:] for t in tokens if t[0] == " "}, {t for t in tokens if t[0] != " "}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        counts = [greedy(w.encode().decode("latin-1"), first, rest) for w in re.findall(r"\w+|[^\w\s]", d.text or "")]
        assert tuple(rows[d.doc_id])[1:] == (len(counts), sum(map(abs, counts)), sum(n < 0 for n in counts))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 1), (2, "x" * 200_000, 1), (3, "a, b", 2)], "doc_id long, text string, n_words int")
    got = sorted(map(str, wordpieces.piece_counts(docs, PATH).select("id", "n_words", "n_unknown").toLocalIterator()))
    assert [re.findall(r"=(\w+)", x) for x in got] == [["1", "0", "0"], ["1", "0", "0"], ["2", "1", "0"], ["3", "3", "0"], ["None", "0", "0"]]
    assert wordpieces.piece_counts(docs.limit(0), PATH).count() == 0


def with_space(word, tokens):
    """Greedy longest match over the bytes of a space and the word."""
    text, at, n = " " + word.encode("utf-8", "surrogatepass").decode("latin-1"), 0, 0
    while at < len(text):
        at = next(e for e in range(len(text), at, -1) if text[at:e] in tokens)
        n += 1
    return n


def test_words_that_no_piece_begins(spark):
    with open(PATH, "rb") as f:
        tokens = {base64.b64decode(x.split()[0]).decode("latin-1") for x in f}
    rnd = random.Random(5)
    texts = ["中文", "你好，世界。 한국어 텍스트", "漢字かな交じり文 and English", "中" * 3000, "\U0010ffff 𝒳 😀", "ñandú Ελληνικά русский עברית ไทย हिन्दी"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x250), rnd.randrange(0x370, 0xD800), rnd.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in wordpieces.piece_counts(docs, PATH).collect():
        words = re.findall(r"\w+|[^\w\s]", texts[r.id])
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(with_space(w, tokens) for w in words), 0), texts[r.id]


def test_random_vocabularies_with_a_bare_beginning():
    rnd = random.Random(4)
    for _ in range(150):
        make = lambda k: {"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(k)}
        first, rest = make(rnd.randint(0, 9)), make(rnd.randint(0, 9)) | set("abc")
        automaton = wordpieces.Automaton(first, rest, bare=True)
        tokens = {" "} | {" " + x for x in first} | rest
        for _ in range(60):
            word = "".join(rnd.choices("abc", k=rnd.randint(1, 14)))
            assert automaton.count(word) == with_space(word, tokens), (word, first, rest)
