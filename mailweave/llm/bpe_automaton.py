"""Byte-pair encoding with a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that merging would produce.  It starts as one state with an arc for every base
symbol and takes one gadget for each merge ``u v -> uv``, in order: the state that ``u`` leads to is copied without its ``v`` arc and
becomes the target of ``u``; every state that has a ``u`` arc gets an arc ``uv`` to where ``u`` and then ``v`` led.  A state is thus
reached by one token, and differs from the state it was copied from by one missing arc; it is stored as that difference, and arcs
are looked up along the copies, on demand: there is no table of transitions.  Encoding a word tries the arcs whose labels spell it,
the longest first, and backtracks; each prefix has one state only.

Text is handled as the vocabulary file says: special tokens are cut out of the raw text, the rest is NFC-normalised, lower-cased
and split at white space and by the file's pattern.  Decoding emits arc labels, joined by blanks, as the file names no decoder.

Cases: a null or empty text has no tokens; ids and repeated rows are not looked at, each row is encoded; texts of any length are
encoded whole, word by word; a word without white space costs time in proportion to its length; an empty table gives an empty table;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm.common import map_batches, read

END = "</w>"
CACHE_WORDS = 300_000  # entries of a worker's memories of words and of chunks; each is emptied when full
CACHE_ARCS = 200_000
# White space as the normaliser's pattern takes it: unlike str.split, without the separators U+001C to U+001F.
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile(r"[\x1c-\x1f]")

# Letters and numbers that the regex module knows and the tokenizer's pattern engine does not (assigned after Unicode 16).
NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, spare = [], 256
    for b in range(256):
        if b in shown:
            names.append(chr(b))
        else:
            names.append(chr(spare))
            spare += 1
    return names


class MergeAutomaton:
    """States are named by the token that leads to them; -1 is the start."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocabulary
        self.labels = {i: t for t, i in vocabulary.items()}
        self.removed: dict[tuple[int, int], int] = {}  # (state, arc) -> the merge that took the arc from the copy
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, the merge that made it
        self.arcs: dict[int, bool] = {}
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.arcs.clear()
        made = set(self.parts)
        labels = [t for t, i in vocabulary.items() if i in made or len(t.removesuffix(END) or t) == 1]
        # Arc labels by their spelling: those that end a word apart, and every prefix, with -1 where it is no label itself.
        self.last = {t.removesuffix(END): vocabulary[t] for t in labels if t.endswith(END)}
        self.inner = {t[:n]: -1 for t in labels for n in range(1, len(t.removesuffix(END)) + 1)}
        self.inner |= {t: vocabulary[t] for t in labels if not t.endswith(END)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if self._lacks(u, v):
            return  # the state after u has no v arc any more: the two never meet
        self.parts[uv] = (u, v, rank)
        self.removed[u, v] = rank

    def _gone(self, state: int, arc: int, before: float) -> bool:
        """Was ``arc`` taken from this state, or from the one it was copied from before that copy, by an earlier merge?"""
        while True:
            rank = self.removed.get((state, arc))
            if rank is not None and rank < before:
                return True
            if state not in self.parts:
                return False
            _, state, made = self.parts[state]
            before = min(before, made)

    def _lacks(self, state: int, arc: int) -> bool:
        """An arc is missing if it was taken, or if its left part was missing when the merge wanted to add it."""
        before = float("inf")
        while not self._gone(state, arc, before):
            if arc not in self.parts:
                return False
            arc, right, rank = self.parts[arc]
            before = rank + (arc == right)  # with u = v the copy has lost its u arc before the merge adds arcs
        return True

    def has_arc(self, state: int, arc: int) -> bool:
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        known = self.arcs[state << 32 | arc] = not self._lacks(state, arc)
        return known

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word of byte symbols.

        Longest arcs are tried first.  A position can be reached in one state only, so one that led nowhere is not tried again.
        """
        known = self.words.get(word)
        if known is not None:
            return known
        n, i, state = len(word), 0, -1
        inner, arcs = self.inner, self.arcs
        tried, path, open_arcs = bytearray(n + 1), [], []
        while i < n:
            ahead = []
            for j in range(i + 1, n):
                label = inner.get(word[i:j])
                if label is None:
                    break
                if label >= 0:
                    ahead.append((label, j))
            else:
                label = self.last.get(word[i:])
                if label is not None:
                    ahead.append((label, n))
            open_arcs.append(ahead)
            while True:
                if not ahead:
                    open_arcs.pop()
                    path.pop()
                    ahead, state = open_arcs[-1], path[-1] if path else -1
                    continue
                label, j = ahead.pop()
                if tried[j]:
                    continue
                if state >= 0:
                    free = arcs.get(state << 32 | label)
                    if not (self.has_arc(state, label) if free is None else free):
                        continue
                tried[j] = 1
                path.append(label)
                i, state = j, label
                break
        found = tuple(path)
        if n <= 64:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = found
        return found


class Codec:
    """Text to ids and ids to text, as the vocabulary file describes."""

    def __init__(self, file: bytes):
        import regex

        described = json.loads(file)
        model = described["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        steps = described["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, rf"[{kind}--[{NEWER}]]")
        self.pattern = regex.compile(pattern, regex.VERSION1)
        self.symbols = byte_symbols()
        # What stands between white space: its ids as 32-bit numbers, and its decoded text.
        self.packed: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def _split(self, chunk: str) -> list[str]:
        """Words of a normalised chunk.  Latin letters with at most one mark behind need no pattern."""
        if max(chunk) < "\u0250":
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # letter by letter: no final sigma
        ids: list[int] = []
        for word in self._split(chunk.lower()):
            if not word.isascii() or not word.isprintable():
                word = "".join(self.symbols[b] for b in word.encode())
            ids.extend(self.automaton.encode(word))
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def forget(self) -> None:
        """Give up what was remembered of words, chunks and arcs."""
        for memory in (self.packed, self.decoded, self.automaton.words, self.automaton.arcs):
            memory.clear()

    def decode(self, ids) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def _segment(self, text: str) -> tuple[list[bytes], list[str]]:
        """Ids and decoded text of each chunk of a text without special tokens."""
        chunks = list(filter(None, SPACE.split(text))) if ODD_SPACE.search(text) else text.split()
        packed, decoded = self.packed, self.decoded
        found = list(map(packed.get, chunks))
        if None not in found:
            return found, list(map(decoded.__getitem__, chunks))
        if len(packed) >= CACHE_WORDS:
            packed.clear()
            decoded.clear()
        long: dict[str, tuple[bytes, str]] = {}
        for chunk in chunks:
            if chunk not in packed:
                made = self._chunk(chunk)
                if len(chunk) <= 64:
                    packed[chunk], decoded[chunk] = made
                else:
                    long[chunk] = made
        if not long:
            return list(map(packed.__getitem__, chunks)), list(map(decoded.__getitem__, chunks))
        return [long[c][0] if c in long else packed[c] for c in chunks], [long[c][1] if c in long else decoded[c] for c in chunks]

    def pieces(self, text: str) -> tuple[bytes, str]:
        """All ids of a text as little-endian 32-bit numbers, and the text decoded from them."""
        if "<|" not in text or not self.cut:
            packed, decoded = self._segment(text)
            return b"".join(packed), " ".join(decoded)
        packed, decoded = [], []
        for k, segment in enumerate(self.cut.split(text)):
            if k % 2:
                packed.append(struct.pack("<I", self.special[segment]))
                decoded.append(segment)
            elif segment:
                more = self._segment(segment)
                packed += more[0]
                decoded += more[1]
        return b"".join(packed), " ".join(decoded)

    def encode(self, text: str | None) -> list[int]:
        packed, _ = self.pieces(text or "")
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@lru_cache(maxsize=2)
def codec(file: bytes) -> Codec:
    """Compiled once in each worker process."""
    return Codec(file)


def tokenizer_file(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def encode(docs: DataFrame, file: bytes, key: str = "doc_id") -> DataFrame:
    """(key, ids): the token ids of every text.  ``file`` is a vocabulary of fixed size and goes to every executor once."""
    kind, known = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(file)

    def run(batch):
        made = codec(known.value)
        return {key: batch.column(0), "ids": [made.encode(t) for t in batch.column(1).to_pylist()]}

    return map_batches(docs.select(key, "text"), f"{key} {kind}, ids array<int>", run, lambda: codec(known.value).forget())


def decode(encoded: DataFrame, file: bytes, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids)."""
    kind, known = encoded.schema[key].dataType.simpleString(), encoded.sparkSession.sparkContext.broadcast(file)

    def run(batch):
        made = codec(known.value)
        return {key: batch.column(0), "text": [made.decode(i or ()) for i in batch.column(1).to_pylist()]}

    return map_batches(encoded.select(key, "ids"), f"{key} {kind}, text string", run)


def digests(docs: DataFrame, file: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    kind, known = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(file)

    def run(batch):
        made = codec(known.value)
        counts, of_ids, of_text = [], [], []
        for text in batch.column(1).to_pylist():
            packed, decoded = made.pieces(text or "")
            counts.append(len(packed) // 4)
            of_ids.append(hashlib.sha256(packed).hexdigest())
            of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run,
                       lambda: codec(known.value).forget())


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    return digests(read(spark, sf_dir, "documents"), tokenizer_file())
