"""Byte-level BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The frequent words of the corpus, with the ids that the merges give them, are compiled into an acyclic automaton whose
states share suffixes; each arc carries the number of words that sort before those it leads to, so that the sum along a
path is the word's place in a table of ids. Arcs lie in a double array. Workers map the packed automaton into memory and
walk all words of a piece of text at once; words outside the lexicon are merged exactly, also many at once. The lexicon
decides only the speed: any lexicon, an empty one too, gives the same ids.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import most_frequent, pieces, released, tidied

#: Words in the lexicon; bytes of text taken up at a time; distinct words that a task counts before it hands them on.
LEXICON, PIECE, COUNTED = 32_768, 1 << 18, 50_000
#: Longer words aren't merged in a batch but one by one, over a heap.
BATCHED = 48
NONE = np.iinfo(np.int32).max

OTHER, LETTER, NUMBER, WHITE, SPACE, EDGE = range(6)

#: Letters and numbers that Unicode 16, which the encoder follows, has beyond version 15.
NEW_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- vocabulary


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others for code
    points from 256 on, in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays: the id of each byte, a hash table of mergeable pairs, each id's bytes, and the special tokens. Tokens that
    are added otherwise, stripping space or outside ASCII, are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, chars = spec["model"]["vocab"], byte_of_char()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    words = [b""] * size
    for token, i in ids.items():
        words[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    for t in spec["added_tokens"]:
        words[t["id"]] = t["content"].encode()
    specials = spec["added_tokens"]
    if rest := [t["content"] for t in specials if not t.get("special", True) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"].isascii()]:
        raise ValueError(f"added tokens of this kind aren't supported: {rest}")
    pairs = np.array([[ids[a], ids[b]] for a, b in merges], np.int64).reshape(-1, 2)
    keys, merged = (pairs[:, 0] << 20 | pairs[:, 1]), np.array([ids[a + b] for a, b in merges], np.int32)
    table_keys, table_ranks = _hash_table(keys)
    by_byte = np.zeros(256, np.int32)
    for c, b in chars.items():
        by_byte[b] = ids[c]
    lengths = np.array([len(w) for w in words], np.int64)
    return {
        "by_byte": by_byte, "pair_keys": table_keys, "pair_ranks": table_ranks, "merged": merged, "token_bytes": np.frombuffer(b"".join(words), np.uint8),
        "token_starts": np.cumsum(lengths) - lengths, "token_lengths": lengths, "special_ids": np.array([t["id"] for t in specials], np.int64), "kinds": char_kinds(), "special_texts": np.frombuffer("\0".join(t["content"] for t in specials).encode(), np.uint8),
    }


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: keys and their places in the list; empty slots hold -1."""
    bits = max(4, int(len(keys) * 4).bit_length())
    table, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
    left, at = np.arange(len(keys)), _slot(keys, bits)
    while len(left):
        free = table[at] == -1
        _, first = np.unique(at[free], return_index=True)
        placed = np.flatnonzero(free)[first]
        table[at[placed]], ranks[at[placed]] = keys[left[placed]], left[placed]
        stay = np.ones(len(left), bool)
        stay[placed] = False
        left, at = left[stay], (at[stay] + 1) & ((1 << bits) - 1)
    return table, ranks


def pair_ranks(v: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The merge rank of each pair of ids, NONE where there is none or an id is missing (-1)."""
    table, ranks = v["pair_keys"], v["pair_ranks"]
    mask, keys = len(table) - 1, (a.astype(np.int64) << 20) | b
    out = np.full(len(keys), NONE, np.int32)
    left = np.flatnonzero((a >= 0) & (b >= 0))
    at = _slot(keys[left], mask.bit_length())
    while len(left):
        found = table[at]
        hit = found == keys[left]
        out[left[hit]] = ranks[at[hit]]
        go = ~hit & (found != -1)
        left, at = left[go], (at[go] + 1) & mask
    return out


# ---- merges


def merge_one(v: dict, word: bytes) -> list[int]:
    """The ids of one word, over a heap of pairs: for words of any length."""
    ids = [int(v["by_byte"][b]) for b in word]
    nxt, prev, alive = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)], [True] * len(ids)
    first = pair_ranks(v, np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], nxt[i] = int(v["merged"][rank]), False, nxt[j]
        if nxt[i] < len(ids):
            prev[nxt[i]] = i
        for x, y in ((prev[i], i), (i, nxt[i])):
            if x >= 0 and y < len(ids):
                r = int(pair_ranks(v, np.array([ids[x]]), np.array([ids[y]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def merge_batch(v: dict, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word; words of like length are merged together, a merge of each word at a time."""
    out: list = [None] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 32), (32, BATCHED)):
        chosen = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(chosen):
            continue
        raw = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in chosen), np.uint8).reshape(-1, high)
        ids = np.where(np.arange(high) < lengths[chosen, None], v["by_byte"][raw], -1).astype(np.int32)
        ranks = pair_ranks(v, ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), high - 1)
        rows, column = chosen, np.arange(high)
        while len(rows):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), j]
            if (ended := best == NONE).any():
                for r, row in zip(rows[ended], ids[ended], strict=True):
                    out[r] = row[row >= 0]
                rows, ids, ranks, j, best = rows[~ended], ids[~ended], ranks[~ended], j[~ended], best[~ended]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            ids[at, j] = v["merged"][best]
            # Close the gap after the merged id, then look up the pairs on both sides of it.
            ids = np.take_along_axis(ids, np.minimum(column + (column > j[:, None]), high - 1), 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] > j[:, None]), high - 2), 1)
            ranks[:, -1] = NONE
            right = np.minimum(j + 1, high - 1)
            inside = j < high - 1
            ranks[at[inside], j[inside]] = pair_ranks(v, ids[at, j], np.where(inside, ids[at, right], -1))[inside]
            before = j > 0
            ranks[at[before], j[before] - 1] = pair_ranks(v, ids[at, np.maximum(j - 1, 0)], ids[at, j])[before]
    for i in np.flatnonzero(lengths > BATCHED):
        out[i] = np.array(merge_one(v, words[i]), np.int32)
    for i in np.flatnonzero(lengths == 0):
        out[i] = np.empty(0, np.int32)
    return out


# ---- words of a text


def char_kinds() -> np.ndarray:
    """The kind of each code point, as the splitting pattern of byte-level vocabularies tells them apart. Made once, on
    the driver, and sent with the vocabulary."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            kinds[at[m.start() : m.end()]] = kind
    # Code points that only later versions assign belong to no kind.
    known = np.zeros(0x110000, bool)
    known[at] = [unicodedata.category(c) != "Cn" for c in text]
    for low, high in NEW_IN_16:
        known[low : high + 1] = True
    kinds[~known], kinds[0x20] = OTHER, SPACE
    return kinds


def split_words(kinds: np.ndarray, data: np.ndarray, starts: np.ndarray, specials: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words begin in the UTF-8 bytes of many texts, which begin at starts (those of empty texts
    left out), and for each word which of the special tokens it is, or -1."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds[points]
    is_special = np.full(len(kind), -1, np.int32)
    begins = np.zeros(len(kind), bool)
    begins[np.searchsorted(at, starts)] = True
    if any(data.tobytes().find(special) >= 0 for special in specials):
        raw, bounds = data.tobytes(), np.append(starts, len(data))
        # The leftmost token, of several that begin there the longest; none runs over the end of its text.
        for m in regex.finditer(b"|".join(regex.escape(x) for x in sorted(specials, key=len, reverse=True)), raw, overlapped=True):
            i = np.searchsorted(at, m.start())
            if kind[i] != EDGE and m.end() <= bounds[np.searchsorted(bounds, m.start(), "right")]:
                kind[i : i + m.end() - m.start()] = EDGE  # of single-byte characters
                is_special[i] = specials.index(m.group())
    before = np.empty_like(kind)
    before[0], before[1:] = EDGE, kind[:-1]
    before[begins] = EDGE
    after = np.empty_like(kind)
    after[-1], after[:-1] = EDGE, kind[1:]
    after[:-1][begins[1:]] = EDGE
    white = (kind == WHITE) | (kind == SPACE)
    white_before = (before == WHITE) | (before == SPACE)
    # White space: a run stands alone but for its last character, which before other characters starts a word itself.
    start = white & (~white_before | ~((after == WHITE) | (after == SPACE) | (after == EDGE)))
    # Others: where the kind changes, unless a space before belongs to the word.
    start |= ~white & (kind != EDGE) & (kind != before) & (before != SPACE)
    start |= is_special >= 0
    # 's 't 're 've 'm 'll 'd, where the quote starts a word.
    quotes = np.flatnonzero((points == 0x27) & start & (kind == OTHER) & (after == LETTER))
    if len(quotes):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        one, two = padded[quotes + 1], np.where(np.append(begins, [True, True])[quotes + 2], 0, padded[quotes + 2])
        c = {x: ord(x) for x in "stmdrvle"}
        single = np.isin(one, [c["s"], c["t"], c["m"], c["d"]])
        double = ((one == c["r"]) & (two == c["e"])) | ((one == c["v"]) & (two == c["e"])) | ((one == c["l"]) & (two == c["l"]))
        for chosen, n in ((quotes[single], 1), (quotes[double], 2)):
            start[chosen + 1] = False
            ends = chosen + 1 + n
            ends = ends[ends < len(kind)]
            start[ends[kind[ends] == LETTER]] = True
    return at[start], is_special[start]


# ---- lexicon


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, numbered so that a path's sum is the word's place."""
    arcs: list[dict[int, int]] = [{}]
    final, register, path = [False], {}, [0]

    def close(upto: int) -> None:
        while len(path) > upto + 1:
            state = path.pop()
            key = (final[state], tuple(sorted(arcs[state].items())))
            if (same := register.setdefault(key, state)) != state:
                parent = arcs[path[-1]]
                for byte, target in parent.items():
                    if target == state:
                        parent[byte] = same

    previous = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, previous)) if a != b), min(len(word), len(previous)))  # noqa: B905
        close(shared)
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]], previous = True, word
    close(0)

    below: dict[int, int] = {}
    order, stack = [], [0]
    while stack:  # children before parents
        state = stack[-1]
        todo = [t for t in arcs[state].values() if t not in below]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()
        if state not in below:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            order.append(state)
    number = {state: i for i, state in enumerate(reversed(order))}  # the start is 0

    # The double array: states with many arcs go first, each from where the one before it went; single arcs fill the holes.
    arcs_in_all = sum(len(arcs[s]) for s in order)
    used, base, placed = bytearray(256 * (len(order) + 2)), np.zeros(len(order), np.int32), []
    lowest = seen = 256
    for state in sorted(order, key=lambda s: (-len(arcs[s]), number[s])):
        labels = sorted(arcs[state])
        if not labels:
            continue
        if len(labels) == 1:
            lowest = slot = used.index(0, lowest)
        else:
            slot = used.index(0, seen)
            while any(used[slot - labels[0] + c] for c in labels):
                slot = used.index(0, slot + 1)
            seen = slot
        b = slot - labels[0]
        base[number[state]], passed = b, int(final[state])
        for c in labels:
            used[b + c] = 1
            placed.append((b + c, number[state], number[arcs[state][c]], passed))
            passed += below[arcs[state][c]]
    slots = max([p[0] for p in placed], default=0) + 512
    owner, target, out = (np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32))
    if arcs_in_all:
        at, owners, targets, passed_on = np.array(placed).T
        owner[at], target[at], out[at] = owners, targets, passed_on
    ends = np.zeros(len(order), bool)
    for state, i in number.items():
        ends[i] = final[state]
    return {"lex_owner": owner, "lex_target": target, "lex_out": out, "lex_base": base, "lex_final": ends, "lex_longest": np.array([max(map(len, words), default=0)])}


def look_up(v: dict, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place in the lexicon of each word, or -1: all words step through the automaton together."""
    found = np.full(len(starts), -1, np.int64)
    live = np.flatnonzero(lengths <= v["lex_longest"][0])
    state, total, at, left = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32), starts[live], lengths[live]
    base, owner, target, out, final = (v[f"lex_{k}"] for k in ("base", "owner", "target", "out", "final"))
    while len(live):
        if (ended := left == 0).any():
            hit = ended & final[state]
            found[live[hit]] = total[hit]
            go = ~ended
            live, state, total, at, left = live[go], state[go], total[go], at[go], left[go]
        slot = base[state] + data[at]
        ok = owner[slot] == state
        if not ok.all():
            live, slot, total, at, left = live[ok], slot[ok], total[ok], at[ok], left[ok]
        state, total = target[slot], total + out[slot]
        at, left = at + 1, left - 1
    return found


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """All arrays one after the other, behind a line that tells their places."""
    places, body, at = {}, [], 0
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[k] = (a.dtype.str, at, len(a))
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    head = json.dumps(places).encode()
    return b"%16d" % len(head) + head + b"\0" * (-(16 + len(head)) % 8) + b"".join(body)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays over a memory map of the file of that name, which an executor has once for all of its workers."""
    if name not in _mapped:
        _mapped.clear()
        whole = np.memmap(SparkFiles.get(name), np.uint8, "r")
        n = int(whole[:16].tobytes())
        at = 16 + n + -(16 + n) % 8
        _mapped[name] = {k: np.asarray(whole[at + start : at + start + size * np.dtype(kind).itemsize].view(kind)) for k, (kind, start, size) in json.loads(whole[16 : 16 + n].tobytes()).items()}
    return _mapped[name]


# ---- encoding and decoding


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column and where each begins and ends; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if col.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(v: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, special = split_words(v["kinds"], data, np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]), [x for x in v["special_texts"].tobytes().split(b"\0") if x])
    return starts, np.diff(np.append(starts, len(data))), special


def encode_piece(v: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin and end."""
    starts, lengths, special = _words(v, data, offsets)
    place = look_up(v, data, starts, lengths)
    count, first = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    known = (place >= 0) & (special < 0)
    count[known], first[known] = v["seq_lengths"][place[known]], v["seq_starts"][place[known]]
    new = np.flatnonzero(~known & (special < 0))
    raw, numbers, order = data.tobytes(), {}, np.empty(len(new), np.int64)
    for k, (s, n) in enumerate(zip(starts[new].tolist(), lengths[new].tolist(), strict=True)):
        order[k] = numbers.setdefault(raw[s : s + n], len(numbers))
    merged = merge_batch(v, list(numbers))
    sizes = np.array([len(m) for m in merged], np.int64)
    # Behind the lexicon's ids: those of new words, then those of special tokens.
    pool = np.concatenate([v["seq_ids"], *merged, v["special_ids"].astype(np.int32)]).astype(np.uint32)
    if len(new):
        count[new], first[new] = sizes[order], (len(v["seq_ids"]) + np.cumsum(sizes) - sizes)[order]
    marked = special >= 0
    count[marked], first[marked] = 1, len(pool) - len(v["special_ids"]) + special[marked]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(first - (ends - count), count) + np.arange(total)]
    upto = np.append(0, ends)
    return ids, upto[np.searchsorted(starts, offsets)]


def decode_ids(v: dict, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for."""
    n = v["token_lengths"][ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return v["token_bytes"][np.repeat(v["token_starts"][ids] - (ends - n), n) + np.arange(total)]


def frequent_words(docs: DataFrame, text: str, vocabulary: dict, most: int = LEXICON) -> list[bytes]:
    """The most frequent words of all texts, counted by all tasks; only so many come to the driver."""

    sent = docs.sparkSession.sparkContext.broadcast({k: vocabulary[k] for k in ("special_texts", "kinds")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for low, high in pieces(batch, 0, PIECE):
                data, offsets = text_bytes(batch.column(0).slice(low, high - low))
                starts, lengths, special = _words(sent.value, data, offsets)
                raw = data.tobytes()
                plain = special < 0
                counts.update([raw[s:e] for s, e in zip(starts[plain].tolist(), (starts + lengths)[plain].tolist(), strict=True)])
                if len(counts) > COUNTED:
                    yield rows()
                    released()
        yield rows()

    words = docs.select(F.col(text)).mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # What occurs once isn't frequent; without it, the table of counts is a small part of the text.
    return [bytes(r.word) for r in most_frequent(words.where("n > 1"), "n", most).collect()]


class Codec:
    """A vocabulary and a lexicon, packed into one file that every executor gets once and its workers map."""

    def __init__(self, spark: SparkSession, vocabulary: dict[str, np.ndarray], words: list[bytes]):
        words = sorted({w for w in words if w})
        seqs = merge_batch(vocabulary, words)
        lengths = np.array([len(s) for s in seqs], np.int64)
        seq = {"seq_ids": np.concatenate([*seqs, np.empty(0, np.int32)]).astype(np.int32), "seq_starts": np.cumsum(lengths) - lengths, "seq_lengths": lengths}
        self.arrays = vocabulary | seq | compile_lexicon(words)
        # Spark brings the file from the driver to each executor, to new ones as well.
        self.name = f"lexicon-{uuid.uuid4().hex}"
        path = Path(tempfile.mkdtemp(prefix="brightloom-")) / self.name
        path.write_bytes(pack(self.arrays))
        spark.sparkContext.addFile(str(path))

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", path: str | None = None, most: int = LEXICON) -> Codec:
        """Counts the words of docs and compiles the most frequent."""
        v = load_vocabulary(path or default_vocabulary())
        return cls(docs.sparkSession, v, frequent_words(docs, text, v, most))

    def _arrays(self):
        name = self.name
        return lambda: mapped(name)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
        """One row for each row of docs, in any order: id_col, the columns to keep, n_tokens, ids (packed as
        little-endian unsigned 32-bit integers) and, if asked for, the decoded text. Null texts are empty and have no
        ids; ids and kept columns pass unchanged, null or not. Repeated rows come back as often as they are there, an
        empty table gives an empty result, and other columns, whatever their names, don't matter."""
        arrays, fixed = self._arrays(), [docs.schema[c] for c in (id_col, *keep)]
        fields = [*fixed, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
        if decoded:
            fields.append(T.StructField("decoded", T.StringType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = arrays()
            for batch in batches:
                at = batch.num_columns - 1
                for low, high in pieces(batch, at, PIECE):
                    part = batch.slice(low, high - low)
                    ids, upto = encode_piece(v, *text_bytes(part.column(at)))
                    # Out of buffers: an array made of memoryviews never gives them back.
                    packed = [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                    cols = [*part.columns[:at], pa.array(np.diff(upto)), pa.Array.from_buffers(pa.binary(), part.num_rows, packed)]
                    if decoded:
                        text_of = [decode_ids(v, ids[a:b]).tobytes().decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                        cols.append(pa.array(text_of, pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])
                # Freed memory goes back between batches, not only at the end.
                released()

        return docs.select(id_col, *keep, F.col(text).alias("__text")).mapInArrow(tidied(run), T.StructType(fields))

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Adds the text that the packed ids stand for; null ids give null. Bytes that aren't UTF-8 become U+FFFD."""
        arrays = self._arrays()

        @F.pandas_udf("string")
        def text_of(col):
            v = arrays()
            return col.map(lambda raw: None if raw is None else decode_ids(v, np.frombuffer(raw, "<u4")).tobytes().decode("utf-8", "replace"))

        return encoded.withColumn(out, text_of(F.col(ids)))
