"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding. It is found from the vocabulary
entries that are suffixes of the prefix (the suffix automaton of the vocabulary reports them), as the one that is
compatible with the last token of the prefix before it. Back-pointers then give the ids. Two tokens are compatible if
merging would keep the border between them; that is tested by undoing merges, latest first.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, slices

NEVER = 1 << 62
#: Pairs of tokens whose compatibility is remembered; some 80 bytes each.
PAIRS = 1 << 18


#: White space of the splitter; str.split() also splits at the four separators U+001C to U+001F.
SPACE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The splitter of the tokenizer file.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = regex.compile(SPLIT_RULE)


def bytes_as_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class Known(dict):
    """Ids of stretches, of two generations: when the young one is full it becomes the old one, so memory is bounded.

    A stretch has one small value; decoded text is made anew from ids, as keeping it takes more than all the rest.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            self[key] = got
        return got


class SuffixAutomaton:
    """All substrings of a set of strings; reading a text, the strings that end at each position.

    A state stands for substrings that end at the same places; its link leads to the longest of their suffixes that
    ends at more. Every string of the set is the longest of its own state, as nothing stands before its first character.
    """

    def __init__(self, entries: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        names: dict[int, int] = {}
        for text, name in entries.items():
            at = 0
            for ch in text:
                at = self._extend(at, ch)
            names[at] = name
        n = len(self.next)
        self.name = [names.get(i, -1) for i in range(n)]
        # The nearest state up the links that is a string of the set; links lead to shorter states.
        self.up = [-1] * n
        for i in sorted(range(1, n), key=self.length.__getitem__):
            link = self.link[i]
            self.up[i] = link if self.name[link] >= 0 else self.up[link]

    def _extend(self, last: int, ch: str) -> int:
        """The state of what `last` stands for, followed by `ch`."""
        nexts, link, length = self.next, self.link, self.length
        found = nexts[last].get(ch)
        if found is not None:
            return found if length[found] == length[last] + 1 else self._split(last, ch, found)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and ch not in nexts[p]:
            nexts[p][ch] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][ch]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, ch, q)
        return new

    def _state(self, nexts: dict[str, int], length: int, link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, ch: str, q: int) -> int:
        """A state of its own for the substrings of q that are no longer than what p and ch give."""
        new = self._state(self.next[q].copy(), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(ch) == q:
            self.next[p][ch] = new
            p = self.link[p]
        return new

    def ends(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(stop, name, length) of every string of the set that ends in `text` before `stop`, by position, longest first."""
        nexts, link, length, name, up = self.next, self.link, self.length, self.name, self.up
        state = matched = 0
        for stop, ch in enumerate(text, 1):
            while (to := nexts[state].get(ch)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state = to
            matched += 1
            # A state may have been reached by less than its longest substring.
            u = state if name[state] >= 0 and length[state] <= matched else up[state]
            while u > 0:
                yield stop, name[u], length[u]
                u = up[u]


class WordBpe:
    """Encoder and decoder for a tokenizer file whose words carry an end mark. The file's normaliser and splitter are used as they are."""

    def __init__(self, spec: str, cache: int = 300_000) -> None:
        from tokenizers import Tokenizer

        raw = json.loads(spec)
        model = raw["model"]
        # Only normaliser and splitter are used, so the library need not hold the vocabulary once more.
        self.lib = Tokenizer.from_str(json.dumps(raw | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        if "".join(raw["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) != SPLIT_RULE or raw["decoder"]:
            raise ValueError("another splitter or decoder than this encoder's")
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.name = {v: k for k, v in self.vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank.setdefault(pair, i)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, i
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.name |= {v: k for k, v in self.special.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # In the automaton a word's end mark is one character more, so that entries with it match only there.
        self.mark = "\x00"
        marked = lambda t: t[: -len(self.end)] + self.mark if self.end and t.endswith(self.end) and t != self.end else t
        self.found = SuffixAutomaton({marked(t): i for t, i in self.vocab.items()})
        self.pairs: dict[int, bool] = {}
        self.odd: set[int] = set()  # entries that don't encode to themselves; parts come before what they make
        for t in sorted(self.vocab.values(), key=lambda t: self.made.get(t, -1)):
            if not self._whole(t):
                self.odd.add(t)
        self.known = Known(self.chunk, cache)
        self.bytes = bytes_as_characters()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging (left text + right text) keeps the border: no merge across it comes before the merges that make the sides."""
        key = left << 20 | right
        if (hit := self.pairs.get(key)) is not None:
            return hit
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        ok = self.pairs[key] = self._compatible(left, right)
        return ok

    def _compatible(self, left: int, right: int) -> bool:
        made, parts, rank = self.made, self.parts, self.rank
        before = NEVER  # a merge across the border counts if it is earlier than this
        tie = False  # or as early as this, where the leftmost of equal merges goes first
        while True:
            r = rank.get((left, right), NEVER)
            if r < before or r == before and tie:
                return False
            x, y = made.get(left, -1), made.get(right, -1)
            if x < 0 and y < 0:
                return True
            # Undo the later of the two; of equal merges the right one was made later.
            if x > y:
                before, tie, left = x, False, parts[left][1]
            else:
                before, tie, right = y, True, parts[right][0]

    def word(self, piece: str) -> list[int]:
        """Ids of one piece: forward over prefixes, then back along the last tokens."""
        text = piece + self.mark if self.end else piece
        n = len(text)
        # token[i], size[i]: what ends the encoding of text[:i]. The mark alone is no entry of the vocabulary.
        token, size = [-1] * (n + 1), [0] * (n + 1)
        odd, compatible = self.odd, self.compatible
        for i, t, k in self.found.ends(text):
            if token[i] < 0 and t not in odd and (k == i or (p := token[i - k]) >= 0 and compatible(p, t)):
                token[i], size[i] = t, k
        out: list[int] = []
        i = n
        while i > 0:
            if token[i] < 0:
                raise ValueError(f"no encoding for {piece!r}")
            out.append(token[i])
            i -= size[i]
        out.reverse()
        return out

    def _whole(self, token: int) -> bool:
        """Whether a token encodes to itself: it is a character or its parts are compatible but for the merge that makes it."""
        if token not in self.parts:
            return token in self.name
        a, b = self.parts[token]
        return a not in self.odd and b not in self.odd and self._merged(a, b, self.made[token])

    def _merged(self, left: int, right: int, last: int) -> bool:
        made, parts, rank = self.made, self.parts, self.rank
        if max(made.get(left, -1), made.get(right, -1)) >= last:
            return False
        first = True
        before, tie = NEVER, False
        while True:
            r = rank.get((left, right), NEVER)
            if not first and (r < before or r == before and tie):
                return False
            first = False
            x, y = made.get(left, -1), made.get(right, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                before, tie, left = x, False, parts[left][1]
            else:
                before, tie, right = y, True, parts[right][0]

    def pieces(self, chunk: str) -> list[str]:
        """What the file's normaliser and splitter make of a stretch without white space.

        Below U+0300 nothing composes, and lower case is a character for a character but for U+0130, so the
        same is computed directly; all else goes through the library.
        """
        if max(chunk) < "\u0300" and "\u0130" not in chunk:
            return [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.bytes) for x in SPLIT.findall(chunk.lower())]
        return [x for x, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(chunk))]

    def chunk(self, chunk: str) -> bytes:
        """Ids as little-endian 32-bit integers of a stretch without white space."""
        ids = [i for piece in self.pieces(chunk) for i in self.word(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunks(self, text: str) -> list[str]:
        return [x for x in SPACE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def plain(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[c] for c in self.chunks(text)])

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null counts as empty."""
        text = text or ""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        ids, done = [], 0
        for m in [*self.at_special.finditer(text), None]:
            ids.append(self.plain(text[done : m.start() if m else len(text)]))
            if m:
                ids.append(self.special[m[0]].to_bytes(4, "little"))
                done = m.end()
        return b"".join(ids)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as bytes, decoded text) of a whole text; null counts as empty."""
        ids = self.ids(text)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included, as the file's (absent) decoder gives it: names joined by blanks."""
        return " ".join(map(self.name.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file, read once on the driver; its size is that of the vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, WordBpe] = {}


def encoder(spec: str) -> WordBpe:
    """One encoder a worker, so that its tables and known words serve every batch."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = WordBpe(spec)
        give_back()
    return _encoders[key]


def _over_texts(docs: DataFrame, spec, make: Callable[[WordBpe, str | None], tuple], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """doc_id and what `make` gives for each text; ids stay in Arrow, so that long ones beside null ones keep their digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = encoder(spec.value)
        for b in slices(batches):
            got = [make(own, t) for t in b.column("text").to_pylist()]
            made = {name: pa.array([g[i] for g in got], kind) for i, (name, kind) in enumerate(columns.items())}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **made})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode_documents(spark: SparkSession, docs: DataFrame, *, path: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded, for every row of `docs`; no shuffle.

    Null and empty texts have no tokens. Null or repeated ids are carried as they are, a row for a row; an empty
    table gives no rows; other columns are not looked at. `ids` and `decoded` switch off what is not needed.
    """
    wanted = {"n_tokens": pa.int64()} | ({"ids": pa.binary()} if ids else {}) | ({"decoded": pa.string()} if decoded else {})

    def make(own: WordBpe, text: str | None) -> tuple:
        x = own.ids(text)
        return (len(x) // 4, *([x] if ids else []), *([own.decode(x)] if decoded else []))

    schema = "doc_id long, n_tokens long" + ", ids binary" * ids + ", decoded string" * decoded
    return _over_texts(docs, spark.sparkContext.broadcast(vocabulary(path)), make, wanted, schema)


def digest_documents(spark: SparkSession, docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text; digests are taken in the worker, so texts cross once.

    Null and empty texts have no tokens and the digests of nothing; else as `encode_documents`.
    """

    def make(own: WordBpe, text: str | None) -> tuple:
        x, y = own.encode(text)
        return len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y.encode()).hexdigest()

    wanted = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _over_texts(docs, spark.sparkContext.broadcast(vocabulary(path)), make, wanted, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
