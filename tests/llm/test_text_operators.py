"""Text operators against plain brute force, on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest

from marquetry.llm import bpe_automaton, decontaminate, line_dedup, substring_dedup, token_counts
from marquetry.llm.queries import word_spec
from tests.llm.conftest import edge_rows


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def brute_lines(docs, min_chars=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= min_chars:
                held[key(x)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(edge, none):
    got = line_dedup.dedup_lines(edge)
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == brute_lines([r[:2] for r in edge_rows()])
    assert set(got.columns) == {*edge.columns, "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_threshold_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a long shared line"), (2, "a long shared line"), (2, "a long shared line")], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()} == {0}
    assert [r.n_dropped for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1, 1]


def brute_passages(docs, window=20):
    words = [(doc, (text or "").encode().split()) for doc, text in docs]
    first = {}
    for doc, w in words:
        if doc is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, (doc, s)), (doc, s))
    out = []
    for doc, w in words:
        gone = set()
        if doc is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] != (doc, s):
                    gone.update(range(s, s + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, b" ".join(kept).decode(), len(w), len(gone)))
    return sorted(out, key=repr)


def test_substring_dedup_edges(edge, none):
    got = substring_dedup.dedup_substrings(edge)
    assert rows(got, "doc_id", "text", "n_words", "n_removed") == brute_passages([r[:2] for r in edge_rows()])
    assert substring_dedup.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_random(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)  # the reduction within chunks is at work, too
    rng = random.Random(seed)
    base = [rng.choice("abc") for _ in range(400)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(400)
            text += base[a : a + rng.randrange(60)]
            text += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
        docs.append((i, " ".join(text)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substring_dedup.dedup_substrings(df, window=12)
    assert rows(got, "doc_id", "text", "n_words", "n_removed") == brute_passages(docs, 12)


def brute_overlap(docs, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for item, body in items:
            b = split(body)
            if b:
                n = min(size, len(b))
                wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) in wins:
                        hit.update(range(s, s + n))
                        found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [
    (1, " ".join(f"Common{i}," for i in range(16))),
    (2, "short"),
    (3, None),
    (4, ""),
    (None, "end one"),
    (5, " ".join(f"common{i}" for i in range(20, 34))),
    (5, " ".join(f"common{i}" for i in range(20, 34))),
]


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_decontamination(spark, edge, none, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_overlap(edge.drop("n_words"), items, block_bytes=block)
    want = brute_overlap([r[:2] for r in edge_rows()], ITEMS)
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == want
    for r in got.where("n_hit > 0").collect():
        spans = [r.text[a:b] for a, b in r.spans]
        assert sum(len(decontaminate.normalise(s).split()) for s in spans) == r.n_hit
    assert decontaminate.find_overlap(none.drop("n_words"), items).count() == 0
    assert decontaminate.find_overlap(edge, items.limit(0), prefix="b_").where("b_n_hit > 0").count() == 0


def test_decontamination_white_space_inside_words(spark):
    signs = "\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    items = [(i, f"Let n{c}= 5 and{c}so on") for i, c in enumerate(signs)]
    items.append((90, " ".join(f"long{i}\xa0x\u3000y" for i in range(20))))
    docs = [(i, f"before, {t} after") for i, t in items]
    docs += [(200 + i, re.sub(f"[{signs}]", " ", t)) for i, t in items]  # plain blanks: other words
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_overlap(df, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == brute_overlap(docs, items)
    assert {r.doc_id for r in got.where("n_hit > 0").collect()} == {i for i, _ in items}


ALPHABET = "aaabbcdeehilnorstuvw   \n\n\t..,-'’éßŒΣσçİ1234567890<|>/w\x1c 　▁漢字😀é#$%&A_()[]\x00"


def texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["th", "in", "er", "the", "ing", "ation", "s", "un", " re", "est", "1", "!!", "  "]
    out = ["", " ", "<|endoftext|>a<|startoftext|>", "'s'S'll I'LL don't", "hello</w> world", " " * 40 + "x", "a" * 200]
    for k in range(n):
        out.append("".join(rng.choice(ALPHABET if k % 2 else parts) for _ in range(rng.randrange(40))))
    return out


def test_prefix_counts_equal_the_library():
    import numpy as np
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PrefixCounter(token_counts.read_pieces(path))
    for text in texts(150):
        want = [len(library.encode(text[:p])) for p in range(1, len(text) + 1)]
        steps = counter.steps(text)
        assert np.cumsum(steps, dtype=int).tolist() == want, text
        for budget in (0, 3, 10):
            assert token_counts.longest_prefix(steps.tobytes(), budget) == max(
                [p for p, n in enumerate(want, 1) if n <= budget], default=0
            )


def test_prefix_counts_of_long_units_without_pairs():
    import numpy as np
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PrefixCounter(token_counts.read_pieces(path))
    for sign in ("あ", "\U0001f600", "\xa0", "あいう", "ไท", "한글"):
        for text in (sign * 100_000, "the" + sign * 100_000 + "ing", sign * 700 + "ation" + sign * 100_000):
            counts = np.cumsum(counter.steps(text), dtype=int)
            assert len(counts) == len(text)
            for p in (1, 2, 50, 702, 2_000, len(text)):
                assert counts[p - 1] == len(library.encode(text[:p]))


def test_token_counts_on_a_table(edge, none):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = token_counts.read_pieces(path)
    counted = token_counts.prefix_token_counts(edge, pieces)
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in edge_rows()]
    assert rows(counted, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    cut = token_counts.truncate(counted, 20)
    assert all(len(library.encode(r.text or "")) <= 20 for r in cut.collect())
    assert token_counts.prefix_token_counts(none, pieces).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe_automaton.WordEncoder(word_spec())


def test_bpe_equals_the_library(encoder):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for text in texts(600):
        want = library.encode(text, add_special_tokens=False).ids
        ids, n, decoded = encoder.encode(text)
        assert (ids, n) == (" ".join(map(str, want)), len(want)), text
        assert decoded == library.decode(want, skip_special_tokens=False) == encoder.decode(want)


def test_a_small_automaton_by_hand():
    auto = bpe_automaton.Automaton(list("ab"), [("a", "a"), ("a", "b"), ("aa", "a")])
    names = lambda w: [auto.text[x] for x in auto.encode(w)]
    assert names("aaab") == ["aa", "ab"]
    assert names("aaaa") == ["aa", "aa"] and names("aaa") == ["aaa"]
    assert names("ba") == ["b", "a"]


def test_bpe_on_a_table(edge, none):
    spec = word_spec()
    both = bpe_automaton.encode_texts(edge, spec)
    again = bpe_automaton.decode_ids(both, spec, decoded="again")
    assert again.where("again <> decoded").count() == 0
    digests = bpe_automaton.encode_digests(edge, spec)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded)) for r in both.collect()]
    assert rows(digests, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_automaton.encode_digests(none, spec).count() == 0
