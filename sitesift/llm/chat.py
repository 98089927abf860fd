"""Chat formatting as a prefix tree of turns.

Conversations that begin with the same turns share those turns' nodes. Every
node is tokenised and emitted once, in depth-first order; it carries its
position ids (tokens of its ancestors first, so a shared turn has the same
positions in every conversation that runs through it). A stretch of nodes that
the same conversations run through is a segment: one interval of the emitted
stream. A node may attend to the intervals of its segment's ancestors, and to
its own segment up to itself.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
The two markers are token ids of their own, after the vocabulary. Inside roles
and texts every ``<``, any number of backslashes, ``|`` gets one more backslash
before the bar, so no control string can stand there, and reading takes one
away again; a role also has its backslashes and newlines escaped. The loss
covers exactly the text tokens of assistant turns.

Scale. Turns are numbered by a range sort and running sums (those inside a
partition plus the totals of the partitions before), so a conversation of any
length is spread over the tasks. A node's id is the running sum of 96-bit
hashes of (place, turn): 38 digits whatever its depth. A node belongs to the
least conversation through it; what a conversation owns is its last turns, so
running sums within owners also give the segments. Only segments carry paths.
Each segment on a path needs a conversation of its own that leaves the path
there, so a path of s segments needs some s * s / 2 turns in the table: paths
stay below the square root of twice the rows, and all of them together have at
most two entries a row. Sorting paths as strings is depth-first order. A join
with a node or segment that more than one row in POPULAR meets is a broadcast
of at most POPULAR small rows; the other keys are joined by a shuffle.

Reading goes through the written stream by the intervals of a conversation's
last segment, in pieces of at most PIECE turns. Each node is decoded once; the
digests of one conversation are then taken in order by one task, batch by
batch (a digest has no parallel form).

Defined cases: a null text is empty, a null role is an empty role; turns are
ordered by (turn, role, text) with nulls first, so repeated rows are repeated
turns. Rows with a null conv_id form one conversation with a null id. Very
long texts are tokens of one node. Other columns are ignored. An empty table
gives an empty tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._runtime import POPULAR, join_popular, running_sums, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The two control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Fixed value: the public split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nodes of a segment that are read under one key.
PIECE = 1000
#: Characters of a popular piece that is broadcast: 64 MB in all.
SHORT = 1 << 16

_OPEN = re.compile(r"<(\\*)\|")
_CLOSE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Coder:
    """Template tokens of a turn, and back. ``ranks``: the vocabulary file."""

    def __init__(self, ranks: bytes):
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.size = max(table.values()) + 1
        self.start, self.end = self.size + 1, self.size + 2
        self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {i: b for b, i in table.items()} | {self.start: START.encode(), self.end: END.encode()}

    def encode(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], int, int]]:
        """Per turn: tokens, and where its text begins and ends in them."""
        heads = self.bpe.encode_ordinary_batch([escape_role(r) + "\n" for r in roles], num_threads=1)
        bodies = self.bpe.encode_ordinary_batch([escape(t) for t in texts], num_threads=1)
        tail = [self.end, *self.bpe.encode_ordinary("\n")]
        return [([self.start, *h, *b, *tail], 1 + len(h), 1 + len(h) + len(b)) for h, b in zip(heads, bodies)]

    def text(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) of each turn of a token sequence."""
        out, at = [], 0
        while at < len(ids):
            stop = ids.index(self.end, at)
            role, _, text = self.text(ids[at + 1:stop]).partition("\n")
            out.append((unescape_role(role), unescape(text)))
            at = stop + 1
            while at < len(ids) and ids[at] != self.start:
                at += 1
        return out


_CODERS: dict[bytes, Coder] = {}


def coder(ranks: bytes) -> Coder:
    key = hashlib.sha1(ranks).digest()
    if key not in _CODERS:
        _CODERS[key] = Coder(ranks)
    return _CODERS[key]


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns by conversation and place (c, k, role, text; c is the id in a
    struct, so that null is an id too), and their nodes: c, k, node, parent."""
    rows = turns.select(F.struct("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = written(running_sums(rows, ["c"], ["turn", "role", "text"], {"k": F.lit(1)}, "chat-turns").drop("turn"), "chat-numbered")
    digest = F.md5(F.concat_ws(":", "k", F.length("role"), F.concat("role", "text")))
    high, low = (F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(15,0)") for at in (1, 13))
    mark = (high * F.lit(1 << 48).cast("decimal(15,0)") + low).cast("decimal(29,0)")
    places = running_sums(rows.select("c", "k", mark.alias("mark")), ["c"], ["k"], {"node": F.col("mark")}, "chat-places")
    return rows, written(places.select("c", "k", "node", (F.col("node") - F.col("mark")).cast("decimal(38,0)").alias("parent")), "chat-places")


def nodes(texts: DataFrame, places: DataFrame, ranks: bytes) -> DataFrame:
    """One row per distinct node: node, parent, owner, k (its depth), through
    (conversations), head (whether a segment begins), tokens and the token
    range of the loss (empty unless an assistant speaks)."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(ranks)      # a vocabulary file, about 1 MB

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(sent.value)
        for batch in batches:
            roles = batch.column("role").to_pylist()
            done = code.encode(roles, batch.column("text").to_pylist())
            size = np.array([len(t) for t, _, _ in done], np.int64)
            flat = np.fromiter((i for t, _, _ in done for i in t), np.int32, int(size.sum()))
            loss = [(a, b) if r == "assistant" else (0, 0) for r, (_, a, b) in zip(roles, done)]
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), T.list_array(flat, size, pa.int32()),
                pa.array([a for a, _ in loss], pa.int32()), pa.array([b for _, b in loss], pa.int32()),
            ], names=["node", "tokens", "loss_from", "loss_to"])

    found = written(places.groupBy("node").agg(F.count("*").alias("through"), F.min("c").alias("owner"), F.min("k").alias("k"),
                                               F.min("parent").alias("parent")), "chat-found")
    said = found.select("node", F.col("owner").alias("c"), "k").join(texts, ["c", "k"]).select("node", "role", "text")
    tokens = said.mapInArrow(tokenised, "node decimal(38,0), tokens array<int>, loss_from int, loss_to int")
    # A node goes on its parent's segment if all conversations through the parent run through it.
    alone = (found.filter("k > 1").groupBy("parent").agg(F.count("*").alias("n"), F.max("node").alias("child"), F.max("through").alias("through"))
             .filter("n = 1").drop("n"))
    goes_on = alone.join(found.select(F.col("node").alias("parent"), "through"), ["parent", "through"])
    goes_on = goes_on.select(F.col("child").alias("node"), F.lit(False).alias("head"))
    whole = found.join(goes_on, "node", "left").withColumn("head", F.coalesce("head", F.lit(True)))
    return written(whole.join(tokens, "node"), "chat-nodes")


def prefix_tree(turns: DataFrame, ranks: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The emitted nodes, written in stream order, their segments, and
    (conv_id, n_turns, segment) of each conversation, whose last turn is the
    last node of that segment.

    Node columns: at (place in the emitted stream), segment (the place where
    its segment begins), piece, depth, tokens, loss_from, loss_to and
    first_position (of its first token; the others follow). Segment columns:
    segment, attends (intervals [from, to) of the stream with their number of
    nodes: ancestors, then itself) and popular."""
    texts, places = numbered(turns)
    tree = nodes(texts, places, ranks)
    n_rows, n_nodes = places.count(), tree.count()
    size = F.size("tokens").cast("bigint")
    laid = written(running_sums(tree.select("node", "parent", "owner", "k", "through", "head", size.alias("n")), ["owner"], ["k"],
                                {"seg": F.col("head").cast("int"), "upto": F.col("n")}, "chat-laid"), "chat-laid")
    segs = laid.groupBy("owner", "seg").agg(
        F.min_by("node", "k").alias("node"), F.max_by("node", "k").alias("last"), F.min("k").alias("k"), F.count("*").alias("nodes"),
        F.sum("n").alias("n"), F.min(F.col("upto") - F.col("n")).alias("before"), F.min("through").alias("through"))
    popular = F.col("through") * POPULAR > n_rows
    segs = written(segs.withColumns({"id": F.md5(F.col("node").cast("string")), "popular": popular}), "chat-segments")
    lines = join_popular(places.select("c", "node"), segs.select("node", "k", "id", "n", "popular"), ["node"])
    lines = lines.groupBy(F.col("c").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("k", "id", "n"))).alias("line"))
    above = F.filter("line", lambda x: x["k"] <= F.col("k"))
    paths = segs.join(lines, "owner").withColumn("line", above)
    paths = paths.withColumn("first_position", F.aggregate("line", F.lit(0).cast("bigint"), lambda t, x: t + x["n"]) - F.col("n"))
    paths = paths.withColumn("line", F.col("line.id")).withColumn("path", F.concat_ws("", "line"))
    ordered = running_sums(paths, [], ["path"], {"end": F.col("n")}, "chat-order").withColumn("segment", F.col("end") - F.col("n"))
    ordered = written(ordered.drop("path"), "chat-paths")
    spans = ordered.select("id", F.col("segment").alias("from"), F.col("end").alias("to"), "nodes", "popular")
    steps = join_popular(ordered.select("segment", F.col("popular").alias("shared"), F.explode("line").alias("id")), spans, ["id"])
    segments = written(steps.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("from", "to", "nodes"))).alias("attends"),
                                                    F.first("shared").alias("popular")), "chat-attends")
    # Segments that hold more than a node in POPULAR.
    of = ordered.select("owner", "seg", "segment", "before", F.col("k").alias("from_k"), "first_position",
                        (F.col("nodes") * POPULAR > n_nodes).alias("popular"))
    inside = F.col("upto") - F.col("n") - F.col("before")
    at = join_popular(laid.select("node", "owner", "seg", "k", "n", "upto"), of, ["owner", "seg"]).select(
        "node", "segment", (F.col("segment") + inside).alias("at"), (F.col("first_position") + inside).alias("first_position"),
        F.floor((F.col("k") - F.col("from_k")) / PIECE).alias("piece"), F.col("k").alias("depth"))
    out = tree.select("node", "tokens", "loss_from", "loss_to").join(at, "node").drop("node")
    parts = max(1, tree.rdd.getNumPartitions())
    out = written(out.repartitionByRange(parts, "at").sortWithinPartitions("at"), "chat-stream")
    ends = places.groupBy("c").agg(F.max("k").cast("bigint").alias("n_turns"), F.max_by("node", "k").alias("last"))
    leaves = join_popular(ends, ordered.select("last", "segment", "popular"), ["last"])
    return out, segments, leaves.select("c.conv_id", "n_turns", "segment")


READ = ("turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, "
        "positions_sha256 string, attends_sha256 string")


class _Reading:
    """The digests of one conversation, node by node in stream order."""

    def __init__(self):
        self.said, self.loss, self.positions, self.spans = (hashlib.sha256() for _ in range(4))
        self.loss_chars = self.chars = self.tokens = self.n_spans = 0
        self.at = self.to = None

    def add(self, r: dict) -> None:
        if r["at"] is None or r["at"] != (r["from"] if self.at == self.to else self.at):
            raise ValueError("an interval is not in the stream")
        if self.at == self.to:
            self.spans.update(f"{',' if self.n_spans else ''}{r['from']}:{r['to']}".encode())
            self.n_spans += 1
        self.at, self.to = r["at"] + r["n"], r["to"]
        self.said.update(r["said"].encode())
        self.loss.update(r["loss"].encode())
        self.positions.update((np.arange(r["n"], dtype="<i8") + r["first_position"]).tobytes())
        self.loss_chars += len(r["loss"])
        self.chars += r["chars"]
        self.tokens += r["n"]

    def row(self) -> tuple:
        if self.at != self.to:
            raise ValueError("an interval is not in the stream")
        return (self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.positions.hexdigest(),
                self.spans.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (leaf, from, at) to a row a leaf."""
    fields = [f.split() for f in READ.split(", ")]
    types = [pa.int64() if t == "bigint" else pa.string() for _, t in fields]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * (len(fields) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.bool_(), *types])],
                                          names=["segment", "popular", *(name for name, _ in fields)])

    key, reading = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if reading is None or r["segment"] != key[0]:
                if reading is not None:
                    rows.append((*key, *reading.row()))
                key, reading = (r["segment"], r["popular"]), _Reading()
            reading.add(r)
        yield packed(rows)
    if reading is not None:
        yield packed([(*key, *reading.row())])


def read_back(tree: DataFrame, segments: DataFrame, leaves: DataFrame, ranks: bytes) -> DataFrame:
    """Per conversation, from the emitted stream alone: what lies in the
    intervals that its last turn attends to. The digests of its turns and of
    the text under the loss, its formatted length, its number of tokens, and
    the digests of their position ids (64-bit little-endian, one after the
    other) and of the intervals (``from:to``, joined by commas)."""
    spark = tree.sparkSession
    sent = spark.sparkContext.broadcast(ranks)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(sent.value)
        keep = ["segment", "piece", "at", "first_position"]
        for batch in batches:
            said, loss, chars, size = [], [], [], []
            for ids, a, b in zip(*(batch.column(c).to_pylist() for c in ("tokens", "loss_from", "loss_to"))):
                said.append("".join(f"{r}\n{t}\n" for r, t in code.turns(ids)))
                loss.append(unescape(code.text(ids[a:b])))
                chars.append(len(code.text(ids)))
                size.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(said, pa.string()), pa.array(loss, pa.string()),
                 pa.array(chars, pa.int64()), pa.array(size, pa.int64())], names=[*keep, "said", "loss", "chars", "n"])

    wanted = segments.join(leaves.select("segment").distinct(), "segment", "left_semi")
    steps = wanted.select("segment", "popular", F.explode("attends").alias("x")).select(
        F.col("segment").alias("leaf"), "popular", "x.from", "x.to",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("x.nodes") - 1) / PIECE))).alias("piece"))
    read = written(tree.mapInArrow(decoded, "segment bigint, piece bigint, at bigint, first_position bigint, said string, loss string, "
                                            "chars bigint, n bigint").withColumnRenamed("segment", "from"), "chat-read")
    # Nodes in popular segments are at most POPULAR, of any length: the long ones are joined by a shuffle.
    many = segments.filter("popular").select(F.col("segment").alias("from"))
    short = read.join(F.broadcast(many), "from").groupBy("from", "piece").agg(F.sum(F.length("said")).alias("size"))
    short = short.filter(F.col("size") <= SHORT).select("from", "piece")
    hot = read.join(F.broadcast(short), ["from", "piece"])
    rest = steps.join(F.broadcast(short), ["from", "piece"], "left_anti")
    # An interval that is not in the stream fails while reading rather than being left out.
    found = steps.join(F.broadcast(hot), ["from", "piece"]).unionByName(rest.join(read, ["from", "piece"], "left"))
    found = found.withColumnRenamed("leaf", "segment").repartition("segment").sortWithinPartitions("segment", "from", "at")
    done = written(found.mapInArrow(_digests, f"segment bigint, popular boolean, {READ}"), "chat-digests")
    return join_popular(leaves, done, ["segment"]).drop("segment")


def load_ranks(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()
