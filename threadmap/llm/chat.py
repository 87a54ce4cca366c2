"""Chat formatting: conversations that share initial turns are merged into prefix trees.

A turn is written as ``### role: text </turn>`` and a newline. Backslash, ``#`` and
``</turn>`` inside a text are escaped by a backslash, so formatting can be undone. A
conversation's turns get the chained digest of all turns up to them, which names a node of
the tree. Nodes with several children are forks. A conversation's place in the order of the
tree is given by the digests that it has right after forks, and by its length, so
conversations with a common beginning stand next to each other. They are dealt in that order
to shards. Each shard is a packed sequence of its own: its writer walks the conversations and
emits each turn that is not shared with the one before, depth-first. A node carries its token
ids, the position id of its first token in its conversation, the token range under the loss
mask (an assistant's text), and the intervals of the shard's stream that it attends to: those
of its ancestors, merged where they touch. A shared turn is emitted once in a shard. Writer
and reader hold the forks of the current path alone, never all of its turns.

Defined cases: null roles and texts count as empty; turns of null conv_id are one
conversation; turns of equal number are ordered by role and text, null numbers first;
repeated rows are repeated turns. An empty table gives no shards. A conversation of any
length is streamed in the task that digests it; of its turns, 16 bytes for each fork on its
path are gathered. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import filesystem, partitions, save, scratch
from .token_files import RunEncoder

START, COLON, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|#|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return START + escape(role).replace(":", "\\:") + COLON


def role_of(head: str) -> str:
    return unescape(head[len(START) : -len(COLON)])


class Tokens:
    """Ids of a byte-level vocabulary, without special ids, and back to text without loss."""

    def __init__(self, path: str):
        self.encoder = RunEncoder(path, special=False)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        library = self.encoder.library
        added = library.get_added_tokens_decoder()
        self.bytes = [b""] * library.get_vocab_size()
        for t, i in library.get_vocab().items():
            if i not in added:
                self.bytes[i] = bytes(byte_of[c] for c in t)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for ids, sizes in self.encoder.encode(pa.array(texts, pa.string())):
            listed, at = ids.tolist(), 0
            for n in sizes.tolist():
                out.append(listed[at : at + n])
                at += n
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8")


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker's tokens of a tokenizer file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at, role, text, parent, digest: turns in order, with the digests of all turns before and up to each."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, at, digest = object(), None, 0, b""
        for frame in batches:
            places, parents, digests = [], [], []
            for c, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                c = None if pd.isna(c) else c
                if state is None or c != current:
                    current, state, at, digest = c, hashlib.sha256(), 0, b""
                for part in (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")):
                    state.update(len(part).to_bytes(8, "little") + part)
                places.append(at)
                parents.append(digest)
                digests.append(digest := state.digest()[:16])
                at += 1
            yield frame[["conv_id", "role", "text"]].assign(at=places, parent=parents, digest=digests)

    return rows.mapInPandas(chain, "conv_id long, role string, text string, at int, parent binary, digest binary")


def ordered(turns: DataFrame) -> DataFrame:
    """c, path, forks, turns: for each conversation the digests after forks, their places, and its length."""
    nodes = turns.select("parent", "digest").distinct()
    forks = nodes.groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select("parent")
    placed = turns.select("conv_id", "at", "parent", "digest")
    after = placed.where("at > 0").join(forks, "parent", "left_semi").union(placed.where("at = 0").select("parent", "conv_id", "at", "digest"))
    paths = after.groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("p"))
    lengths = turns.groupBy(F.col("conv_id").alias("d")).agg(F.count("*").alias("turns"))
    joined = paths.join(lengths, paths["c"].eqNullSafe(lengths["d"]))
    return joined.select("c", F.transform("p", lambda x: x["digest"]).alias("path"), F.transform("p", lambda x: x["at"]).alias("forks"), "turns")


def _grown(intervals: list[list[int]], start: int, stop: int) -> list[list[int]]:
    """Intervals and one more, which continues the last where they touch."""
    if intervals and intervals[-1][1] == start:
        return [*intervals[:-1], [intervals[-1][0], stop]]
    return [*intervals, [start, stop]]


def write(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the shards to the shared folder; the saved manifest (path, conversations)."""
    spark = conversations.sparkSession
    turns = save(numbered(conversations), "turns")
    by = ["path", "turns", "c"]
    order = ordered(turns).repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    ranked = save(order.select("c", "forks", F.monotonically_increasing_id().alias("rank")), "ranks")
    placed = turns.join(ranked, turns["conv_id"].eqNullSafe(ranked["c"]))
    placed = placed.select("rank", "conv_id", "at", "role", "text", "digest", F.array_contains("forks", F.col("at")).alias("fork"))
    dealt = placed.repartitionByRange(partitions(spark), "rank").sortWithinPartitions("rank", "at")
    base = scratch(spark, "chat")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        tokens, heads = tokens_of(tokenizer), {}
        (end_ids,) = tokens.encode([END])
        raw = out = None
        name, done = f"{base}/{uuid.uuid4().hex}.jsonl.gz", 0
        # what a node leaves to its children: turns up to it, its number, the intervals up to it, the position after it
        tip: tuple[int, int, list[list[int]], int] = (0, -1, [], 0)
        forks: list[list] = [[tip, None]]  # forks of the path, each with the digest of its child there
        node = offset = passed = 0
        shared, rank, conv = True, None, None

        def end() -> None:
            nonlocal done
            out.write((json.dumps({"end": conv, "node": tip[1]}) + "\n").encode())
            done += 1

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512).to_pydict()
                if out is None:
                    raw = fs.open_output_stream(filesystem(name)[1], compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1)
                new = [r for r in dict.fromkeys(rows["role"]) if r not in heads]
                heads = {**(heads if len(heads) < 1000 else {}), **dict(zip(new, tokens.encode([header(r) for r in new])))}
                heads.update((r, tokens.encode([header(r)])[0]) for r in set(rows["role"]) if r not in heads)
                bodies = tokens.encode([escape(t) for t in rows["text"]])
                for r, c, at, role, digest, fork, body in zip(rows["rank"], rows["conv_id"], rows["at"], rows["role"], rows["digest"], rows["fork"], bodies):
                    if r != rank:
                        if rank is not None:
                            end()
                        rank, conv, shared, passed, parent = r, c, True, 0, None
                    if shared:
                        if at == tip[0]:
                            shared, parent = False, tip
                        elif not fork:
                            continue
                        else:
                            passed += 1
                            if forks[passed - 1][1] == digest:
                                continue
                            del forks[passed:]
                            shared, parent = False, forks[-1][0]
                    if fork and forks[-1][0][0] == at:
                        forks[-1][1] = digest
                    elif fork:
                        forks.append([parent, digest])
                    head = heads[role]
                    ids = head + body + end_ids
                    line = {
                        "node": node, "parent": parent[1], "fork": fork, "start": offset, "position": parent[3], "head": len(head), "ids": ids,
                        "loss": [len(head), len(head) + len(body)] if role == "assistant" else [0, 0], "attend": parent[2],
                    }
                    out.write((json.dumps(line, separators=(",", ":")) + "\n").encode())
                    parent = tip = (at + 1, node, _grown(parent[2], offset, offset + len(ids)), parent[3] + len(ids))
                    node, offset = node + 1, offset + len(ids)
        if rank is not None:
            end()
            out.close()
            raw.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "conversations": [done]})

    return save(dealt.mapInArrow(shard, "path string, conversations long"), "chat-manifest")


@dataclass
class _Read:
    """What the reader knows at a node of the turns up to it."""

    node: int
    turns: int
    text: object
    loss: int
    masked: object
    chars: int
    tokens: int

    def copy(self) -> _Read:
        return _Read(self.node, self.turns, self.text.copy(), self.loss, self.masked.copy(), self.chars, self.tokens)


def read(manifest: DataFrame, tokenizer: str) -> DataFrame:
    """What each conversation reads as: counts and digests over its turns and over the text under its loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(tokenizer)
        for listed in batches:
            for name, expected in zip(listed["path"], listed["conversations"]):
                fs, path = filesystem(name)
                tip = _Read(-1, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0)
                forks = [tip.copy()]
                rows, count, heads = [], 0, {}
                with fs.open_input_stream(path, compression="gzip") as stream:
                    for line in _lines(stream):
                        x = json.loads(line)
                        if "end" in x:
                            if x["node"] != tip.node:
                                raise ValueError(f"{name} ends a conversation apart from its last turn")
                            rows.append((x["end"], tip.turns, tip.text.hexdigest(), tip.loss, tip.masked.hexdigest(), tip.chars, tip.tokens))
                            count += 1
                            continue
                        if x["parent"] != tip.node:
                            while forks[-1].node != x["parent"]:
                                forks.pop()
                            tip = forks[-1].copy()
                        elif x["fork"] and forks[-1].node != tip.node:
                            forks.append(tip.copy())
                        ids, (a, b) = x["ids"], x["loss"]
                        key = tuple(ids[: x["head"]])
                        if key not in heads:
                            heads = {**(heads if len(heads) < 1000 else {}), key: tokens.decode(key)}
                        masked = tokens.decode(ids[a:b])
                        body = masked + tokens.decode(ids[b:]) if b else tokens.decode(ids[x["head"] :])
                        role, text = role_of(heads[key]), unescape(body[: -len(END)])
                        tip.text.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        masked = unescape(masked)
                        tip.masked.update(masked.encode("utf-8", "surrogatepass"))
                        tip.node, tip.turns, tip.loss = x["node"], tip.turns + 1, tip.loss + len(masked)
                        tip.chars, tip.tokens = tip.chars + len(heads[key]) + len(body), tip.tokens + len(ids)
                if count != expected:
                    raise ValueError(f"{name} has {count} conversations, not {expected}")
                frame = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
                yield frame.astype({"conv_id": "Int64"})

    return manifest.repartition(max(partitions(manifest.sparkSession), 1), "path").mapInPandas(scan, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest
