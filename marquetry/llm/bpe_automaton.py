"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into one deterministic automaton whose arcs are tokens. It starts with a single state and
a loop for every base symbol. The gadget of a merge ``u v -> w`` gives the target of the ``u`` arcs a copy without
its ``v`` arc, leads all ``u`` arcs to the copy, and lays a ``w`` arc beside every ``u`` arc to where the ``v`` arc led. A
sequence of tokens is the encoding of its string exactly if it is a path.

All arcs with one label share their target, so a state is named by its label and copies are kept by difference: ``cut``
records which arc a gadget took from which state, and when. An arc laid at time t exists where the arc it was laid
beside existed then; ``follows`` resolves that and the results fill the transition table used for encoding.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame

from .common import add_columns, kept

CHUNKS = 400_000  # encoded pieces between blanks that a worker keeps; beyond that it starts anew
WORDS = 60_000  # encoded words likewise
LONGEST = 64
ARCS = 120_000
END = "\x00"  # stands for the word end inside labels; no byte symbol uses it
CLASS = "\ue000"  # a place holder in patterns
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u02ff]")  # U+0130 becomes two signs in lower case
PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these as well


class Automaton:
    """Deterministic automaton over tokens for a list of merges."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]]):
        self.text = list(alphabet)
        self.made = [0] * len(alphabet)
        self.left = [-1] * len(alphabet)
        self.right = [-1] * len(alphabet)
        self.labels: dict[str, tuple[int, ...]] = {x: (i,) for i, x in enumerate(alphabet)}
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        for time, (a, b) in enumerate(merges, 1):
            for u in self.labels.get(a, ()):
                for v in self.labels.get(b, ()):
                    self.gadget(u, v, time)
        starts: dict[str, set[int]] = {}
        for x in self.text:
            if len(x) > 2:
                starts.setdefault(x[:3], set()).add(len(x))
        self.starts = {k: sorted(v, reverse=True) for k, v in starts.items()}

    def gadget(self, u: int, v: int, time: int) -> None:
        if not self.follows(u, v):
            return  # no path holds this pair, so the merge changes nothing
        w = len(self.text)
        self.text.append(self.text[u] + self.text[v])
        self.made.append(time)
        self.left.append(u)
        self.right.append(v)
        self.labels[self.text[w]] = (*self.labels.get(self.text[w], ()), w)
        self.cut[u, v] = time

    def follows(self, x: int, y: int) -> bool:
        """Whether the state that the ``x`` arcs lead to has a ``y`` arc."""
        cut, made, left, right = self.cut, self.made, self.left, self.right
        until = len(self.made) + len(cut)  # later than any gadget
        while True:
            state, seen = x, until
            while state >= 0:
                if cut.get((state, y), seen + 1) <= seen:
                    return False
                seen = min(seen, made[state] - 1)  # a new label's target was copied as it stood before
                state = right[state]
            if left[y] < 0:
                return True
            until, y = made[y], left[y]

    def encode(self, word: str) -> list[int]:
        """Labels of the one path that spells ``word``, whose last symbol may carry the word end.

        Arcs are tried longest first. A prefix has one path at most, so a position that led nowhere needs no second visit.
        """
        n, labels, table, starts = len(word), self.labels, self.table, self.starts
        path: list[int] = []
        ends, dead = [0], set()
        trials = [iter((*starts.get(word[:3], ()), 2, 1))]
        while ends[-1] < n:
            at = ends[-1]
            for size in trials[-1]:
                end = at + size
                if end > n or end in dead:
                    continue
                for y in labels.get(word[at:end], ()):
                    if not path or table.get((path[-1], y)) or self.arc(path[-1], y):
                        break
                else:
                    continue
                path.append(y)
                ends.append(end)
                trials.append(iter((*starts.get(word[end : end + 3], ()), 2, 1)))
                break
            else:
                dead.add(at)
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                path.pop()
                ends.pop()
                trials.pop()
        return path

    def arc(self, x: int, y: int) -> bool:
        """An entry of the transition table, made when first needed."""
        known = self.table.get((x, y))
        if known is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            known = self.table[x, y] = self.follows(x, y)
        return known


def char_class(pattern: str) -> str:
    """Ranges, for inside [...], of the signs that the tokenizer's own regular expressions take for ``pattern``."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    runs = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in runs)


def lower_map() -> dict[int, str]:
    """Lower-casing sign by sign, without regard to what stands beside it, as the tokenizer does it."""
    from tokenizers import normalizers

    every = list(map(chr, (*range(11, 0xD800), *range(0xE000, 0x20000))))
    lower = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    return {ord(a): b for a, b in zip(every, lower, strict=True) if a != b}


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable in Latin-1, else the next sign from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordEncoder:
    """Encoding and decoding of whole texts for a word-end BPE vocabulary (parsed tokenizer file)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        own = lambda s: s[: -len(self.suffix)] + END if s.endswith(self.suffix) and s != self.suffix else s
        self.names: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        alphabet = [x for s in self.symbols for x in (s, s + END)]
        self.automaton = Automaton(alphabet, [(a, own(b)) for a, b in model["merges"]])
        self.token = [self.ids[x[:-1] + self.suffix if x.endswith(END) else x] for x in self.automaton.text]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in ("L", "N"):
            pattern = pattern.replace(f"[\\p{{{name}}}]", f"[{CLASS}{name}]").replace(f"\\p{{{name}}}", f"{CLASS}{name}")
            pattern = pattern.replace(f"{CLASS}{name}", char_class(rf"\p{{{name}}}"))
        self.pre = re.compile(pattern.replace(r"\s", WHITE)).findall
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = [s[:2] for s in self.special]
        self.lower = lower_map()
        self.not_white = re.compile(f"[^{WHITE}]+").findall
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            symbols = "".join([self.symbols[b] for b in word.encode()]) + END
            found = [self.token[x] for x in self.automaton.encode(symbols)]
            if len(word) <= LONGEST:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk_ids(self, chunk: str) -> list[int]:
        """Token ids of a piece of text without white space and special strings."""
        if BEYOND_LATIN.search(chunk):
            chunk = unicodedata.normalize("NFC", chunk).translate(self.lower)
        else:
            chunk = chunk.lower()
            if chunk.isalpha():
                return self.encode_word(chunk)
        return [i for word in self.pre(chunk) for i in self.encode_word(word)]

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        """Ids as text, their number, and the labels as text."""
        if chunk[-1] in ".,;:!?" and chunk[-2:-1].isalpha() and not BEYOND_LATIN.search(chunk):
            # a sign after a letter is always a word of its own, so the two parts are looked up apart
            a = self.chunks.get(chunk[:-1]) or self.chunk(chunk[:-1])
            b = self.chunks.get(chunk[-1]) or self.chunk(chunk[-1])
            return f"{a[0]} {b[0]}", a[1] + b[1], f"{a[2]} {b[2]}"
        ids = self.chunk_ids(chunk)
        found = " ".join(map(str, ids)), len(ids), " ".join([self.names[i] for i in ids])
        if len(chunk) <= LONGEST:
            if len(self.chunks) >= CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        if any(m in text for m in self.marks):
            out = []
            for k, part in enumerate(self.parts.split(text)):
                out += [(str(self.special[part]), 1, part)] if k % 2 else self.pieces_plain(part)
            return out
        return self.pieces_plain(text)

    def pieces_plain(self, text: str) -> list[tuple[str, int, str]]:
        if not BEYOND_LATIN.search(text):
            text = text.lower()  # up to U+02FF normalisation changes nothing, and lower-casing goes sign by sign
        split = self.not_white(text) if PYTHON_ONLY_SPACE.search(text) else text.split()
        known, chunk = self.chunks, self.chunk
        return [known.get(c) or chunk(c) for c in split]

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """Ids and labels of a text, each joined by blanks, and the number of tokens."""
        own = self.pieces(text or "")
        return " ".join([p[0] for p in own]), sum([p[1] for p in own]), " ".join([p[2] for p in own])

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined as the tokenizer without a decoder joins them."""
        return " ".join([self.names[i] for i in ids])


def _encoder(spec: str) -> WordEncoder:
    """One encoder per Python worker: the automaton is compiled once and its words serve the next task as well."""
    return kept(("bpe", hash(spec)), lambda: WordEncoder(spec))


def encode_texts(
    docs: DataFrame, spec: str, text_col: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the decimal ``ids`` of each text joined by blanks, ``n_tokens`` and the ``decoded`` text.

    ``spec`` is the content of a tokenizer file with word ends. Null and empty texts give no ids and an empty decoded text.
    Special strings inside a text become their own ids. Rows don't depend on one another; columns named like an
    output are replaced, others pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)  # the size of a vocabulary file

    def make():
        encoder = _encoder(held.value)

        def encode(texts):
            rows = [encoder.encode(t) for t in texts]
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        return encode

    return add_columns(docs, [text_col], make, f"`{ids}` string, `{n_tokens}` bigint, `{decoded}` string")


def encode_digests(docs: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the ids and the decoded text."""
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def make():
        encoder = _encoder(held.value)

        def encode(texts):
            rows = [encoder.encode(t) for t in texts]
            digest = lambda k: [hashlib.sha256(r[k].encode()).hexdigest() for r in rows]
            return [r[1] for r in rows], digest(0), digest(2)

        return encode

    return add_columns(docs, [text_col], make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, spec: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decoded`` from ``ids`` (decimal, joined by blanks); null gives an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(spec)

    def make():
        encoder = _encoder(held.value)
        return lambda rows: ([encoder.decode([int(i) for i in (r or "").split()]) for r in rows],)

    return add_columns(encoded, [ids], make, f"`{decoded}` string")
