"""Byte-pair ids of long texts by tree concatenation.

A text of more than LEAF characters is halved down to leaves of equal size, wherever the cuts
fall. The leaves are encoded on their own; two neighbours are joined by encoding a window around
their seam again, growing it until its first unit is the left side's and its last whole unit is
the right side's, token for token. A unit is what stands between spaces, or a word of it where
that is long. What lies beyond the window cannot change, as the pattern that finds words crosses
no space and looks at most LITERAL characters ahead, and the tokens of a word follow from the word
alone. For the same reason a leaf takes units that the task has met before from a table.

Inside one word that runs across the seam the window consists of tokens instead. Merges are
applied in the order they were learned and each token has one derivation, so a row of tokens is a
word's encoding if each pair of neighbours is the encoding of its own concatenation. A window
whose first and last tokens are those of the two sides leaves only pairs that some encoding holds.

Texts of more than SPREAD bytes are cut into stretches that many tasks encode; a last task per
text joins them in the same way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quotemill.llm.common import saved

LEAF = 4096  # characters
STRETCH = 64 * LEAF  # characters that one task encodes of a text that is spread
SPREAD = 1 << 20  # bytes
LITERAL = 3  # the longest alternative of PATTERN that is no run of one class
LONG_UNIT = 256  # characters between spaces that are one unit at most
LONG_RUN = 32  # a word of this length on both sides of a seam is joined by tokens
MOST_UNITS = 300_000  # units a task remembers at a time
FIRST_REACH = 64  # characters of the first window on each side of a seam

# Fixed value: the pattern by which the public vocabulary's words are found.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


class Run:
    """Units `lo` to `hi` of one encoding: its ids, the first token and the start of each unit, whether they are words."""

    __slots__ = ("ids", "firsts", "starts", "words", "lo", "hi")

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, starts: np.ndarray, words: bool, lo: int = 0, hi: int | None = None):
        self.ids, self.firsts, self.starts, self.words, self.lo = ids, firsts, starts, words, lo
        self.hi = len(firsts) if hi is None else hi

    def part(self, lo: int, hi: int) -> Run:
        return Run(self.ids, self.firsts, self.starts, self.words, lo, hi)

    def token(self, i: int) -> int:
        return int(self.firsts[i]) if i < len(self.firsts) else len(self.ids)

    def word(self, i: int) -> np.ndarray:
        return self.ids[self.token(i) : self.token(i + 1)]

    def tokens(self) -> np.ndarray:
        return self.ids[self.token(self.lo) : self.token(self.hi)]


class Node:
    """A span of a normalised text and its words, as runs of words of several encodings."""

    def __init__(self, start: int, end: int, runs: list[Run]):
        self.start, self.end = start, end
        self.runs = [run for run in runs if run.hi > run.lo]

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *(run.tokens() for run in self.runs)])

    def backward(self) -> Iterator[tuple[int, int, int]]:
        """(run, word, start) from the last word to the first."""
        for r in range(len(self.runs) - 1, -1, -1):
            run = self.runs[r]
            for i in range(run.hi - 1, run.lo - 1, -1):
                yield r, i, int(run.starts[i])

    def forward(self) -> Iterator[tuple[int, int, int]]:
        for r, run in enumerate(self.runs):
            for i in range(run.lo, run.hi):
                yield r, i, int(run.starts[i])

    def before(self, r: int, i: int) -> list[Run]:
        """The runs up to a word, without it."""
        return [*self.runs[:r], self.runs[r].part(self.runs[r].lo, i)]

    def since(self, r: int, i: int) -> list[Run]:
        """The runs from a word on."""
        return [self.runs[r].part(i, self.runs[r].hi), *self.runs[r + 1 :]]

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        """ids; tokens, start and kind of each unit."""
        sizes = [len(run.word(i)) for run in self.runs for i in range(run.lo, run.hi)]
        starts = [start - self.start for _, _, start in self.forward()]
        kinds = [run.words for run in self.runs for _ in range(run.lo, run.hi)]
        return self.ids().tobytes(), np.asarray(sizes, np.int64).tobytes(), np.asarray(starts, np.int64).tobytes(), bytes(kinds)

    @staticmethod
    def unpack(start: int, end: int, ids: bytes, sizes: bytes, starts: bytes, kinds: bytes) -> Node:
        counts, kind = np.frombuffer(sizes, np.int64), np.frombuffer(kinds, np.uint8)
        first, at, all_ids = np.cumsum(counts) - counts, np.frombuffer(starts, np.int64) + start, np.frombuffer(ids, "<u4")
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        return Node(start, end, [Run(all_ids, first, at, bool(kind[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a])


class TreeEncoder:
    """Encodes whole texts as the library does, long ones as a tree; one per task."""

    def __init__(self, settings: str):
        self.whole = Tokenizer.from_str(settings)
        rules = json.loads(settings)
        self.specials = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.mark = os.path.commonprefix(list(self.specials))  # what all special tokens begin with
        # Without normaliser and special tokens: for parts of a text that are through with both.
        bare = rules | {"normalizer": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        # Without word ends as well: for the inside of a word.
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": rules["model"] | {"end_of_word_suffix": None}})).model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {"": b""}  # ids of units
        self.latin = self._latin(rules["normalizer"])
        suffix, vocab = rules["model"]["end_of_word_suffix"] or "", rules["model"]["vocab"]
        self.width = np.zeros(max([*vocab.values(), *self.specials.values()], default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(suffix) if suffix else token)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parted = [self.segments(text) for text in texts]
        if len(self.table) > MOST_UNITS:
            self.table = {"": b""}
        self.remember(s for segments in parted for s in segments if isinstance(s, str))
        return [np.concatenate([np.zeros(0, "<u4"), *map(self._segment_ids, segments)]) for segments in parted]

    def remember(self, texts) -> None:
        """Have the ids of all short units of the texts in the table."""
        new = [u for u in set().union(*(text.split(" ") for text in texts)).difference(self.table) if len(u) <= LONG_UNIT]
        for start in range(0, len(new), 4096):
            units = new[start : start + 4096]
            found = self.bare.encode(units, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4").tobytes()
            ends = np.cumsum(4 * np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(units))).tolist()
            self.table.update((u, ids[a:b]) for u, a, b in zip(units, [0, *ends], ends))

    def segments(self, text: str) -> list[str | int]:
        """The normalised texts between special tokens, and the ids of these, in order."""
        out: list[str | int] = []
        begin = 0
        for found in self.special.finditer(text) if self.mark in text else ():
            out += [text[begin : found.start()], self.specials[found.group()]]
            begin = found.end()
        return [self.normalised(s) if isinstance(s, str) else s for s in [*out, text[begin:]] if s != ""]

    def normalised(self, text: str) -> str:
        """The text as the library normalises it, but for the number of spaces between units."""
        if self.latin:
            try:
                return text.encode("latin-1").translate(self.latin).decode("latin-1")
            except UnicodeEncodeError:
                pass
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def _latin(self, normalizer: dict | None) -> bytes | None:
        """What becomes of each Latin-1 character, if that does not depend on its neighbours.

        Characters below U+0300 do not combine, and lower case is taken character by character.
        """
        steps = (normalizer or {}).get("normalizers", [])
        if any(step != SPACES and step["type"] not in ("NFC", "Lowercase") for step in steps):
            return None
        each = [self.whole.normalizer.normalize_str(chr(i)) for i in range(256)] if steps else []
        return "".join(each).encode("latin-1") if steps and all(len(c) == 1 and c < "\u0100" for c in each) else None

    def _segment_ids(self, segment: str | int) -> np.ndarray:
        if isinstance(segment, int):
            return np.asarray([segment], "<u4")
        if len(segment) <= LEAF:
            units = segment.split(" ")
            if max(map(len, units)) <= LONG_UNIT:
                return np.frombuffer(b"".join(map(self.table.__getitem__, units)), "<u4")
        return self.tree(segment, 0, len(segment)).ids()

    def tree(self, text: str, start: int, end: int) -> Node:
        """The node of text[start:end]: its leaves are encoded in one batch, then joined upwards."""
        cuts = [*range(start, end, LEAF), end]
        return self.joined(text, self._nodes(text, list(zip(cuts, cuts[1:]))))

    def joined(self, text: str, nodes: list[Node]) -> Node:
        """Neighbours joined pairwise, level by level, to one node."""
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [self.join(text, *pair) if len(pair) == 2 else pair[0] for pair in pairs]
        return nodes[0]

    def _nodes(self, text: str, spans: list[tuple[int, int]]) -> list[Node]:
        parts = [text[a:b] for a, b in spans]
        self.remember(parts)
        return [Node(a, b, self._runs(part, a)) for part, (a, b) in zip(parts, spans)]

    def _runs(self, part: str, base: int) -> list[Run]:
        units = part.split(" ")
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = base + np.cumsum(sizes + 1) - sizes - 1
        if sizes.max() <= LONG_UNIT:
            return self._units(units, starts, sizes)
        runs, last = [], 0
        for i in np.flatnonzero(sizes > LONG_UNIT).tolist():
            runs += self._units(units[last:i], starts[last:i], sizes[last:i])
            found = self.bare.encode(units[i], add_special_tokens=False)
            firsts = np.flatnonzero(np.diff(np.asarray(found.word_ids, np.int64), prepend=-1))
            offsets = np.asarray(found.offsets, np.int64).reshape(-1, 2)
            runs.append(Run(np.asarray(found.ids, "<u4"), firsts, offsets[firsts, 0] + starts[i], True))
            last = i + 1
        return runs + self._units(units[last:], starts[last:], sizes[last:])

    def _units(self, units: list[str], starts: np.ndarray, sizes: np.ndarray) -> list[Run]:
        """The run of short units, without the empty ones between neighbouring spaces."""
        parts = list(map(self.table.__getitem__, units))
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        real = sizes > 0
        firsts = (np.cumsum(counts) - counts)[real]
        return [Run(np.frombuffer(b"".join(parts), "<u4"), firsts, starts[real], False)] if len(firsts) else []

    def join(self, text: str, left: Node, right: Node) -> Node:
        """The node of two neighbours."""
        if not left.runs or not right.runs:
            # Only white space on one side, or nothing: no word ends or begins at the seam.
            return Node(left.start, right.end, left.runs + right.runs)
        if self._runs_across(text, left, right):
            return self._join_word(text, left, right)
        seam, reach = left.end, FIRST_REACH
        while True:
            # The window begins with a whole word of the left side that ends before its last one.
            words = left.backward()
            next(words)
            begun = next((w for w in words if w[2] <= seam - reach - LITERAL), None)
            begin = begun[2] if begun else left.start
            end = min(right.end, seam + reach)
            window = self._nodes(text, [(begin, end)])[0]
            if begun is None or np.array_equal(window.runs[0].word(0), left.runs[begun[0]].word(begun[1])):
                kept = left.before(*begun[:2]) if begun else []
                if end == right.end:
                    return Node(left.start, right.end, kept + window.runs)
                # A word both have, whole in the window: another one begins after it, in time for
                # the pattern to have seen all it looks at.
                there = {}
                for r, i, start in right.forward():
                    if start > end:
                        break
                    there[start] = (r, i)
                mine = list(window.forward())
                for (w, i, start), (_, _, following) in zip(mine, mine[1:]):
                    if start >= seam and start in there and following <= end - LITERAL:
                        r, j = there[start]
                        if np.array_equal(window.runs[w].word(i), right.runs[r].word(j)):
                            return Node(left.start, right.end, [*kept, *window.before(w, i), *right.since(r, j)])
            reach *= 2

    def _runs_across(self, text: str, left: Node, right: Node) -> bool:
        """Whether one long run of letters, or of other signs, goes on from left to right."""
        seam = left.end
        _, _, last = next(left.backward())
        words = right.forward()
        if not (left.runs[-1].words and right.runs[0].words):
            return False
        if text[seam - 1].isspace() or next(words)[2] != seam or seam - last < LONG_RUN:
            return False
        stop = next(words, (0, 0, right.end))[2]
        if stop - seam < LONG_RUN or any(map(str.isspace, text[seam : seam + LONG_RUN])):
            return False
        around = text[seam - LITERAL - 1 : seam + LITERAL + 1]
        return len(self.bare.pre_tokenizer.pre_tokenize_str(around)) == 1

    def _join_word(self, text: str, left: Node, right: Node) -> Node:
        """Join two nodes whose last and first words are parts of one."""
        seam, (r, i, word) = left.end, next(left.backward())
        ended, begun = left.runs[r].word(i), right.runs[0].word(right.runs[0].lo)
        back, ahead = np.cumsum(self.width[ended[::-1]]), np.cumsum(self.width[begun])
        as_bytes = lambda s: self.bytes.pre_tokenize_str(s)[0][0] if s else ""
        reach = FIRST_REACH
        while True:
            before = as_bytes(text[max(word, seam - reach) : seam])
            after = as_bytes(text[seam : min(right.end, seam + reach)])[: int(ahead[-1])]
            m, n = (int(np.searchsorted(x, len(y), "right")) for x, y in ((back, before), (ahead, after)))
            if m and n:
                window = before[len(before) - int(back[m - 1]) :] + after[: int(ahead[n - 1])]
                # The word's end counts only if the window reaches it.
                model = self.bare.model if n == len(begun) else self.inner
                ids = np.asarray([t.id for t in model.tokenize(window)], "<u4")
                if (m == len(ended) or ids[0] == ended[-m]) and (n == len(begun) or ids[-1] == begun[n - 1]):
                    whole = np.concatenate([ended[: len(ended) - m], ids, begun[n:]])
                    joined = Run(whole, np.zeros(1, np.int64), np.asarray([word]), True)
                    rest = right.runs[0].part(right.runs[0].lo + 1, right.runs[0].hi)
                    return Node(left.start, right.end, [*left.before(r, i), joined, rest, *right.runs[1:]])
            reach *= 2


def check_settings(settings: str) -> None:
    """Raise ValueError unless the joins above are exact for a tokenizer with these settings."""
    rules = json.loads(settings)
    model, words = rules["model"], rules["pre_tokenizer"]
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    steps = words.get("pretokenizers", []) if words else []
    if len(steps) != 2 or steps[0] != split or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        raise ValueError("words must be found by the known pattern and mapped to bytes")
    options = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(x) for x in options):
        raise ValueError("only a plain byte-pair model can be joined")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]):
        raise ValueError("special tokens must be found in the raw text as they stand")
    if rules["truncation"] or rules["padding"]:
        raise ValueError("truncation and padding must be off")
    made: dict[str, int] = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if a + b in made or max(made.get(a, -1), made.get(b, -1)) >= rank:
            raise ValueError("a token has two derivations")
        made[a + b] = rank
    if any(max(made.get(a, -1), made.get(b, -1)) > made[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])):
        raise ValueError("a merge precedes its parts")


def _batch(owners: list, ids: list[np.ndarray], tokenizer: Tokenizer) -> pa.RecordBatch:
    decoded = tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
    columns = [pa.array(owners, pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])


OUT = "doc_id long, ids binary, decoded string"


def encode(docs: DataFrame, settings: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids (binary), decoded (string).

    `settings` is the content of the tokenizer's file (checked to be below 64 MB, as it travels
    with the job). `ids` are little-endian unsigned 32-bit ids of the whole text without begin and
    end ids, `decoded` is the library's text of these ids with special tokens. A null or empty
    text, or one of white space, has no ids and decodes to an empty string. Repeated rows and null
    keys are rows like any other; other columns are ignored.

    `docs` is read twice, once for the texts of more than SPREAD bytes, which are stored.
    """
    if len(settings) > 64 << 20:
        raise ValueError("the settings are too large to travel with the job")
    check_settings(settings)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > SPREAD

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = TreeEncoder(settings)
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield _batch(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), encoder.whole)

    short = rows.where(~is_long).mapInArrow(run, OUT)
    return short.unionByName(_spread(saved(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "bpe-long"), settings))


def _spread(rows: DataFrame, settings: str) -> DataFrame:
    """`encode` for stored rows (doc_id, text, row) of very long texts."""
    names = ["row", "doc_id", "segment", "part", "special", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    arrays = "row long, doc_id long, segment int, part int, special long"

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = TreeEncoder(settings)
        for batch in stream:
            for r in range(batch.num_rows):
                owner, text, row = (batch.column(c)[r].as_py() for c in ("doc_id", "text", "row"))
                for s, segment in enumerate(encoder.segments(text) or [""]):
                    parts = [(None, segment[a : a + STRETCH]) for a in range(0, max(1, len(segment)), STRETCH)] if isinstance(segment, str) else [(segment, "")]
                    for p, (special, piece) in enumerate(parts):
                        values = [row, owner, s, p, special, piece]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def leaves(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = TreeEncoder(settings)
        for batch in stream:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                special, text = one.column("special")[0].as_py(), one.column("text")[0].as_py()
                # A special token is a part without words.
                packed = encoder.tree(text, 0, len(text)).pack() if text else (np.asarray([] if special is None else [special], "<u4").tobytes(), b"", b"", b"")
                columns = [*(one.column(c) for c in names), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "sizes", "starts", "kinds"])

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, segments, owner = TreeEncoder(settings), {}, None
        for batch in stream:
            for piece in batch.to_pylist():
                owner = piece["doc_id"]
                segments.setdefault(piece["segment"], {})[piece["part"]] = piece
        out = []
        for _, pieces in sorted(segments.items()):
            text, nodes = "".join(p["text"] for _, p in sorted(pieces.items())), []
            if not text:
                out.append(np.frombuffer(pieces[0]["ids"], "<u4"))
                continue
            for part, p in sorted(pieces.items()):
                at = part * STRETCH
                nodes.append(Node.unpack(at, at + len(p["text"]), p["ids"], p["sizes"], p["starts"], p["kinds"]))
            out.append(encoder.joined(text, nodes).ids())
            pieces.clear()
        yield _batch([owner], [np.concatenate(out)], encoder.whole)

    meet.__annotations__ = {"stream": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    stretches = rows.mapInArrow(cut, f"{arrays}, text string").repartition(F.col("row"), F.col("segment"), F.col("part"))
    nodes = stretches.mapInArrow(leaves, f"{arrays}, text string, ids binary, sizes binary, starts binary, kinds binary")
    return nodes.groupBy("row").applyInArrow(meet, OUT)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode`'s rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
