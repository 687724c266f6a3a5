"""Byte-level BPE with a lexicon of frequent words.

Words are counted over all documents. The most frequent are encoded once and compiled into a
minimal acyclic automaton: suffixes are shared, each arc carries how many words sort before
those behind it, so the walk of a word adds up to its place in the lexicon, where its ids
are. The automaton, the merges and the token bytes are one file image that tasks map into
memory. A word that is not in it is merged exactly, by the ranks of the vocabulary, many words
at a time.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchaselens.llm.common import chunks, map_texts, stored
from purchaselens.llm.pretokens import Specials, byte_level
from purchaselens.llm.wordids import WordIds, ragged

#: Words in the lexicon; its image stays near 100 bytes for each.
LEXICON_WORDS = 100_000
#: Longer words are left to merging.
LONGEST = 48
#: Bytes of text that a task counts or encodes at a time; a longer text is one chunk.
CHUNK = 250_000
#: Words that a task remembers beside the lexicon's.
REMEMBERED = 100_000
#: Words whose counts a task adds up before it passes them on.
COUNTED = 400_000


# -- the image: named arrays in one block of bytes ------------------------------------------

def pack(arrays: dict[str, np.ndarray], more: dict) -> bytes:
    at, places, body = 0, {}, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[name] = [at, a.dtype.str, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps({"arrays": places, "more": more}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def unpack(image) -> tuple[dict[str, np.ndarray], dict]:
    size = int.from_bytes(image[:8], "little")
    head = json.loads(bytes(image[8 : 8 + size]))
    return {
        name: np.frombuffer(image, kind, n, 8 + size + at)
        for name, (at, kind, n) in head["arrays"].items()
    }, head["more"]


def mapped(image: bytes) -> mmap.mmap:
    """The image as a read-only mapping of an unnamed file: pages are dropped under pressure."""
    with tempfile.TemporaryFile() as f:
        f.write(image)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


# -- vocabulary --------------------------------------------------------------------------------

def _byte_letters() -> list[str]:
    """The printable stand-in that vocabulary files use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def vocabulary(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Merges, bytes of each token and ids of single bytes, inside a word and at its end, from
    a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, added = given["model"], given["added_tokens"]
    vocab, letters = model["vocab"], _byte_letters()
    to_byte = {c: b for b, c in enumerate(letters)}
    Specials(added)
    size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
    token = [b""] * size
    for text, i in vocab.items():
        if all(c in to_byte for c in text):
            token[i] = bytes(to_byte[c] for c in text)
    for t in added:
        token[t["id"]] = t["content"].encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys, kind="stable")
    return {
        "pair_keys": keys[order], "pair_ranks": order.astype(np.int32), "made": made,
        "byte_ids": np.array([vocab[c] for c in letters], np.int32),
        "end_ids": np.array([vocab[c + (model["end_of_word_suffix"] or "")] for c in letters], np.int32),
        "token_ends": np.cumsum([len(t) for t in token]).astype(np.int64),
        "token_bytes": np.frombuffer(b"".join(token), np.uint8),
    }, {"size": size, "added": added}


class Merger:
    """Exact merging: always the pair of lowest rank, the leftmost of several."""

    NONE = np.int32(2**31 - 1)
    WIDTHS = (8, 16, 32, 64)

    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        self.keys, self.ranks, self.made = (arrays[k] for k in ("pair_keys", "pair_ranks", "made"))
        self._hash()
        self.byte_ids, self.end_ids, self.size = arrays["byte_ids"], arrays["end_ids"], size
        first = np.repeat(self.byte_ids, 256)
        # Ranks of two bytes, the second inside the word or at its end.
        self.byte_pairs = self._rank(first, np.tile(self.byte_ids, 256))
        self.end_pairs = self._rank(first, np.tile(self.end_ids, 256))

    def _hash(self) -> None:
        """Pairs in a table four times their number or more, each in the first free slot from its own on."""
        bits = max(4, int(4 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        # One table's length more at the end, so that a row of full slots does not run out of it.
        self.slot_keys = np.full(2 << bits, -1, np.int64)
        self.slot_ranks = np.full(2 << bits, self.NONE, np.int32)
        slot, left = self._slot(self.keys), np.arange(len(self.keys))
        while len(left):
            first = np.unique(slot[left], return_index=True)[1]
            taken = left[first[self.slot_keys[slot[left[first]]] < 0]]
            self.slot_keys[slot[taken]], self.slot_ranks[slot[taken]] = self.keys[taken], self.ranks[taken]
            left = np.setdiff1d(left, taken)
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        held = self.slot_keys[slot]
        rank = np.where(held == key, self.slot_ranks[slot], self.NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] += 1
            held = self.slot_keys[slot[open_]]
            hit = held == key[open_]
            rank[open_[hit]] = self.slot_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return rank

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        # By width, each width in order; what is longer than all of them comes last.
        widths = np.searchsorted(self.WIDTHS, np.fromiter(map(len, words), np.int64, len(words)))
        order = np.argsort(widths, kind="stable")
        for k, group in enumerate(np.split(order, np.searchsorted(widths[order], range(1, len(self.WIDTHS) + 1)))):
            for start in range(0, len(group), 20_000):
                part = group[start : start + 20_000].tolist()
                chosen = [words[i] for i in part]
                found = self._together(chosen, self.WIDTHS[k]) if k < len(self.WIDTHS) else map(self._long, chosen)
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def _together(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.zeros((n, width), np.int32)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        tokens = np.where(inside, self.byte_ids[raw], np.int32(-1))
        ranks = np.full((n, width), self.NONE, np.int32)
        both = inside[:, 1:]
        pairs = raw[:, :-1] * 256 + raw[:, 1:]
        ranks[:, :-1][both] = self.byte_pairs[pairs[both]]
        some, last = np.flatnonzero(lengths), lengths[lengths > 0] - 1
        tokens[some, last] = self.end_ids[raw[some, last]]
        some, last = np.flatnonzero(lengths > 1), lengths[lengths > 1] - 1
        ranks[some, last - 1] = self.end_pairs[pairs[some, last - 1]]
        # Tokens stay in place; each knows the columns of those beside it, past the ends -1 and ``width``.
        column = np.arange(width)
        after = np.where(column + 1 < lengths[:, None], column + 1, width).ravel()
        before = np.tile(column - 1, n)
        flat_tokens, flat_ranks, todo = tokens.reshape(-1), ranks.reshape(-1), np.arange(n)
        while len(todo):
            open_ = ranks[todo]
            at = open_.argmin(axis=1)
            best = open_[np.arange(len(todo)), at]
            live = best != self.NONE
            todo, at, best = todo[live], at[live], best[live]
            row = todo * width
            place, merged = row + at, self.made[best]
            # The pair becomes one token at ``place``; its right half goes.
            gone = row + after[place]
            flat_tokens[place], flat_tokens[gone], flat_ranks[gone] = merged, -1, self.NONE
            right = after[gone]
            after[place], flat_ranks[place] = right, self.NONE
            some = np.flatnonzero(right < width)
            beside = row[some] + right[some]
            before[beside] = at[some]
            flat_ranks[place[some]] = self._rank(merged[some], flat_tokens[beside])
            left = before[place]
            some = np.flatnonzero(left >= 0)
            beside = row[some] + left[some]
            flat_ranks[beside] = self._rank(flat_tokens[beside], merged[some])
        kept = tokens >= 0
        flat = tokens[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _long(self, word: bytes) -> bytes:
        """One long word: a heap of pairs over a linked list."""
        token = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        token[-1:] = [int(self.end_ids[b]) for b in word[-1:]]
        n = len(token)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                key = token[i] * self.size + token[j]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(heap, (int(self.ranks[at]), i, token[i], token[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()


# -- lexicon -------------------------------------------------------------------------------

def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct words.

    Sorted input closes a state as soon as a word leaves it; a closed state equal to an earlier
    one (same end mark, same arcs) is that state, which is what shares suffixes.
    """
    known: dict[tuple, int] = {}
    words_behind: list[int] = []
    open_: list[list] = [[False, []]]  # end mark, arcs (byte, state)
    previous = b""

    def close(depth: int) -> None:
        while len(open_) > depth + 1:
            end, arcs = open_.pop()
            open_[-1][1].append((previous[len(open_) - 1], intern(end, arcs)))

    def intern(end: bool, arcs: list) -> int:
        key = (end, *arcs)
        if key not in known:
            known[key] = len(known)
            words_behind.append(int(end) + sum(words_behind[s] for _, s in arcs))
        return known[key]

    for word in words:
        same = 0
        for a, b in zip(previous, word, strict=False):
            if a != b:
                break
            same += 1
        close(same)
        open_.extend([False, []] for _ in word[same:])
        open_[-1][0] = True
        previous = word
    close(0)
    root = intern(*open_[0])
    keys, targets, skipped = [], [], []
    ends = np.zeros(len(known), np.uint8)
    for (end, *arcs), state in known.items():
        ends[state], before = end, int(end)
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            skipped.append(before)
            before += words_behind[target]
    return {
        "arc_keys": np.array(keys, np.int64), "arc_targets": np.array(targets, np.int32),
        "arc_skips": np.array(skipped, np.int32), "ends": ends, "root": np.array([root], np.int64),
    }


def find_words(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Place of each word among the sorted words of the lexicon, -1 if it is not there."""
    n = len(words)
    place, state = np.full(n, -1, np.int64), np.full(n, lexicon["root"][0], np.int64)
    keys = lexicon["arc_keys"]
    if not len(keys) or not n:
        return place
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = np.zeros((n, LONGEST), np.uint8)
    inside = (np.arange(LONGEST) < lengths[:, None]) & (lengths <= LONGEST)[:, None]
    letters[inside] = np.frombuffer(b"".join(w for w in words if len(w) <= LONGEST), np.uint8)
    walking = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
    total = np.zeros(n, np.int64)
    for depth in range(LONGEST):
        wanted = state[walking] * 256 + letters[walking, depth]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        good = keys[at] == wanted
        walking, at = walking[good], at[good]
        state[walking] = lexicon["arc_targets"][at]
        total[walking] += lexicon["arc_skips"][at]
        over = lengths[walking] == depth + 1
        ended = walking[over]
        ended = ended[lexicon["ends"][state[ended]] == 1]
        place[ended] = total[ended]
        walking = walking[~over]
        if not len(walking):
            break
    return place


# -- encoding ----------------------------------------------------------------------------------

class Codec:
    """Encoder and decoder over an image."""

    def __init__(self, image):
        self.arrays, more = unpack(image)
        self.specials = Specials(more["added"])
        self.merger = Merger(self.arrays, more["size"])
        self.word_ids = WordIds(self._learn, self.specials.ids, REMEMBERED)
        self.token_ends = self.arrays["token_ends"]
        self.token_sizes = np.diff(self.token_ends, prepend=0)

    def fresh(self) -> Codec:
        """The same codec with nothing remembered."""
        other = copy.copy(self)
        other.word_ids = WordIds(other._learn, self.specials.ids, REMEMBERED)
        return other

    def _learn(self, words: list[str]) -> list[bytes]:
        return self.words([w.encode() for w in words])

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: looked up in the lexicon, merged where it has none."""
        place = find_words(self.arrays, words).tolist()
        ends, ids = self.arrays["id_ends"], self.arrays["ids"]
        unseen = [i for i, p in enumerate(place) if p < 0]
        out = [b""] * len(words)
        for i, p in enumerate(place):
            if p >= 0:
                out[i] = ids[(ends[p - 1] if p else 0) : ends[p]].tobytes()
        for i, merged in zip(unseen, self.merger.ids([words[i] for i in unseen]), strict=True):
            out[i] = merged
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; NULL is empty."""
        words: list[str] = []
        counts = []
        for text in texts:
            before = len(words)
            for k, part in enumerate(self.specials.parts(text or "")):
                # No pattern gives a special token as a word, so as a word it stands for itself.
                words += [part] if k % 2 else byte_level(part)
            counts.append(len(words) - before)
        return self.word_ids.encode(words, counts)

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids, special tokens as their strings; broken UTF-8 becomes U+FFFD."""
        token = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sizes = self.token_sizes[token]
        places, ends = ragged(self.token_ends[token] - sizes, sizes)
        raw = self.arrays["token_bytes"][places].tobytes()
        cuts = np.append(0, ends)[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; a task adds up the counts of its blocks of texts first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            summed = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table([summed["word"], summed["n_sum"]], ["word", "n"])

        for batch in batches:
            column = batch.column(0)
            # Texts become Python strings chunk by chunk, not all of a batch at once.
            for start, end in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK):
                words: list[str] = []
                for one in column.slice(start, end - start).to_pylist():
                    words += byte_level(one or "")
                counted = pa.array(words, pa.string()).value_counts()
                held.append(pa.table([counted.field("values"), counted.field("counts")], ["word", "n"]))
                if sum(map(len, held)) > COUNTED:
                    held = [added()]
                    if len(held[0]) > COUNTED // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from added().to_batches()

    return (
        docs.select(text).mapInArrow(work, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


def frequent_words(counts: DataFrame, words: int) -> list[bytes]:
    """The most frequent words, ``words`` at most, sorted.

    A histogram of the counts in steps of 4 % gives the count from which on there are no more
    than that; only the words from there on come to the driver."""
    step = F.floor(F.log2("n") * 16).cast("int")
    kept = stored(counts.where(F.octet_length("word").between(1, LONGEST)).withColumn("step", step), "word-counts")
    room, least = words, 0
    for r in sorted(kept.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            least = r.step + 1
            break
    return sorted(r.word.encode() for r in kept.where(F.col("step") >= least).select("word").collect())


def build_image(docs: DataFrame, path: str, *, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Vocabulary and lexicon of the most frequent words as one image."""
    arrays, more = vocabulary(path)
    frequent = frequent_words(word_counts(docs, text), words)
    ids = Merger(arrays, more["size"]).ids(frequent)
    return pack(
        arrays | compile_lexicon(frequent) | {
            "ids": np.frombuffer(b"".join(ids), "<u4"),
            "id_ends": np.cumsum([len(i) // 4 for i in ids] or [0]).astype(np.int64),
        },
        more,
    )


_HELD: dict[str, Codec] = {}


def held_codec(shared, name: str) -> Codec:
    """The codec of a broadcast image, mapped once per worker process. What a task remembers goes with it:
    the process lives on through stages that need its memory."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Codec(mapped(shared.value))
    return _HELD[name].fresh()


def _codec(docs: DataFrame, image: bytes) -> Callable[[], Codec]:
    """What gives a task its codec; the image reaches the workers as a broadcast, its size is
    bounded by the lexicon's and the vocabulary's."""
    shared, name = docs.sparkSession.sparkContext.broadcast(image), hashlib.sha256(image).hexdigest()
    return lambda: held_codec(shared, name)


def encode(
    docs: DataFrame, path: str, *, text: str = "text", image: bytes | None = None,
    decoded: bool = False, keep_text: bool = True, words: int = LEXICON_WORDS,
) -> DataFrame:
    """``docs`` plus ``ids`` (binary: little-endian unsigned 32-bit) and, if asked for,
    ``decoded``: the text decoded from those ids.

    NULL and empty texts have no ids. Every row is encoded whole and by itself, so repeated
    rows give equal ids. Columns of the input named like the new ones are replaced. An empty
    table gives an empty one.
    """
    codec = _codec(docs, build_image(docs, path, text=text, words=words) if image is None else image)

    def make():
        own = codec()

        def work(texts: list[str | None]) -> list[list]:
            ids = own.encode(texts)
            return [ids, own.decode(ids)] if decoded else [ids]

        return work

    fields = [T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * decoded
    return map_texts(docs, text, fields, make, keep_text, CHUNK)
