"""Chat formatting into token prefix trees.

A turn is written as ``<|turn|>role\\ntext<|end|>\\n``; control strings inside roles and texts get a backslash after their
first character, and backslashes are doubled, so that no marker can be forged and every text comes back exactly. A turn's
tokens depend on the turn alone. Conversations that share initial turns are merged into a prefix tree; its nodes' tokens
are emitted once, depth first, with position ids that continue from the parent, and with the intervals of the sequence
that a node may attend to: its ancestors' tokens and, causally, its own.

Every turn of the forest is emitted once, however many conversations share it. A node with more conversations below it than
a task should hold belongs to a trunk: a block of its own, which holds such nodes in a row as long as all conversations go on through
them. What stands below trunks is dealt by the turn that follows the last of
them, so each subtree has one owner; its block names the trunks above it, in order, and attends to all of their tokens
before its own. So neither a common opening nor a conversation that is repeated many times makes a large task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, partitions
from tessera.llm.skew import skew_join

#: The markers of this template and of other common ones, none of which may occur in an escaped text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.S)
#: The role whose texts are learned from.
LEARNED = "assistant"

#: ``above`` are the trunks over a block, from the first turn on, with their numbers of tokens. Nodes have their intervals in
#: the block's own tokens; a conversation with leaf -1 ends with the last trunk above.
BLOCK = (
    "block_id string, above array<struct<block_id:string,tokens:int>>, token_ids array<int>, position_ids array<int>, "
    "nodes array<struct<parent:int,start:int,end:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:long,leaf:int>>"
)
_INT, _SPAN = pa.int32(), pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("parent", _INT), ("start", _INT), ("end", _INT), ("loss_start", _INT), ("loss_end", _INT), ("attends", pa.list_(_SPAN))])
_BLOCK = pa.schema(
    [
        ("block_id", pa.string()),
        ("above", pa.list_(pa.struct([("block_id", pa.string()), ("tokens", _INT)]))),
        ("token_ids", pa.list_(_INT)),
        ("position_ids", pa.list_(_INT)),
        ("nodes", pa.list_(_NODE)),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", _INT)]))),
    ]
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the escaped text, and what stands after it."""
    return f"<|turn|>{escape(role)}\n".replace("\n", "\\\n", role.count("\n")), escape(text), "<|end|>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; an error if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@cache
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tree:
    """A prefix forest over turns; node 0 is the root above all first turns and has no tokens."""

    def __init__(self) -> None:
        self.children: list[dict[tuple[str, str], int]] = [{}]
        self.turns: list[tuple[str, str]] = [("", "")]
        self.leaves: list[tuple[int | None, int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        node = 0
        for turn in turns:
            below = self.children[node]
            if turn not in below:
                below[turn] = len(self.turns)
                self.turns.append(turn)
                self.children.append({})
            node = below[turn]
        self.leaves.append((conv_id, node))

    def emit(self, encode, base: int = 0) -> dict:  # noqa: ANN001
        """The tree's tokens, depth first, as the columns of a block; positions go on from ``base``."""
        ids: list[int] = []
        positions: list[int] = []
        nodes: list[dict] = []
        new = {0: -1}
        todo = [(c, -1, base, []) for c in reversed(self.children[0].values())]
        while todo:
            node, parent, position, attends = todo.pop()
            new[node] = len(nodes)
            role, text = self.turns[node]
            head, body, tail = (encode(x) for x in turn_parts(role, text))
            start = len(ids)
            ids += head + body + tail
            positions += range(position, position + len(ids) - start)
            learned = role == LEARNED
            nodes.append({"parent": parent, "start": start, "end": len(ids), "loss_start": start + len(head), "loss_end": start + len(head) + len(body) * learned, "attends": attends})
            joined = attends and attends[-1]["end"] == start
            below = [*attends[:-1], {"start": attends[-1]["start"], "end": len(ids)}] if joined else [*attends, {"start": start, "end": len(ids)}]
            todo += [(c, new[node], position + len(ids) - start, below) for c in reversed(self.children[node].values())]
        return {"token_ids": ids, "position_ids": positions, "nodes": nodes, "conversations": [{"conv_id": c, "leaf": new[n]} for c, n in self.leaves]}


def _turns(row: dict) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in row["turns"]]


_KEYED = "conv_id long, turns array<struct<turn:long,role:string,text:string>>, keys array<string>, leaf string, chars long, place long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the 128-bit key of every prefix of a conversation: a hash of the turn and of the key before it."""
    place = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            keys, chars = [], []
            for turns in part.column(1).to_pylist():
                key, own = b"", []
                for t in turns:
                    role, text = (t[x].encode() for x in ("role", "text"))
                    key = hashlib.blake2b(key + b"%d:" % len(role) + role + text, digest_size=16).digest()
                    own.append(key.hex())
                keys.append(own)
                chars.append(sum(len(t["text"]) + 32 for t in turns))
            added = [pa.array(keys, pa.list_(pa.string())), pa.array([k[-1] for k in keys], pa.string()), pa.array(chars, pa.int64()), pa.array(range(place, place + len(keys)), pa.int64())]
            place += len(keys)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *added], [f.split()[0] for f in _KEYED.split(", ")])


def blocks(conversations: DataFrame, tokenizer: str, pattern: str, *, share_chars: int = 1 << 17, block_chars: int = 1 << 16) -> DataFrame:
    """One row a block of prefix trees (see ``BLOCK``) for ``conversations(conv_id, turn, role, text)``.

    A conversation's rows are ordered by turn, then role, then text, so repeated rows and ties have one order; a null
    role or text is empty, and a row without a conv_id is a conversation of its own. A conversation is one training example
    and is held in memory as a whole; a node with more than ``share_chars`` code points of two or more conversations below it is
    in a trunk, and trees share a block up to about ``block_chars``. An empty table gives no blocks; further columns are ignored.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    named = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = named.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    whole = materialize(whole.mapInArrow(_keyed, _KEYED), "conversations")

    sizes = whole.select(F.explode("keys").alias("key"), "chars").groupBy("key").agg(F.sum("chars").alias("size"), F.count("*").alias("n"))
    hot = materialize(sizes.where((F.col("size") > share_chars) & (F.col("n") > 1)), "trunks")
    # Conversations with one leaf share their whole path, so paths are looked up once a leaf.
    paths = materialize(whole.select("leaf", "keys").dropDuplicates(["leaf"]).select("leaf", F.posexplode("keys").alias("depth", "key")), "paths")
    on_path = skew_join(paths, hot, ["key"])
    # Large nodes in a row that the same conversations go through are one trunk, named by the last of them.
    along = Window.partitionBy("leaf").orderBy("depth")
    goes_on = (F.lead("depth").over(along) == F.col("depth") + 1) & (F.lead("n").over(along) == F.col("n"))
    on_path = on_path.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("NOT goes_on").select("leaf", "depth", "key", "size")
    on_path = materialize(on_path, "on_path")
    last = on_path.groupBy("leaf").agg(F.max(F.struct((F.col("depth") + 1).alias("depth"), "key", "size")).alias("last"), F.sort_array(F.collect_list("depth")).alias("marks"))
    deep = last.select("leaf", "marks", "last.depth", F.col("last.key").alias("trunk"), F.ceil(F.col("last.size") / share_chars).alias("shares"))
    dealt = skew_join(whole, deep, ["leaf"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    # The turn below the trunks; null where a conversation ends with its trunk, which only its own place can deal.
    dealt = dealt.withColumn("unit", F.get("keys", F.col("depth")))
    by = F.when(F.col("unit").isNull(), F.xxhash64("conv_id", "place")).otherwise(F.xxhash64("unit"))
    dealt = dealt.withColumn("share", F.when(F.col("trunk").isNull(), 0).otherwise(F.pmod(by, F.col("shares"))))
    # A share holds about share_chars at most, and a group a few shares.
    total = whole.agg(F.sum("chars")).first()[0] or 0
    groups = max(partitions(conversations.sparkSession), -(-total // (4 * share_chars)))
    owner = F.when(F.col("trunk").isNull(), F.xxhash64("unit")).otherwise(F.xxhash64("trunk", "share"))
    dealt = dealt.select(F.pmod(owner, F.lit(groups)).alias("group"), F.coalesce("trunk", F.lit("")).alias("trunk"), "share", F.coalesce("unit", F.lit("")).alias("unit"), "depth", "marks", "conv_id", "place", "turns", "keys")

    def above(row: dict, depth: int) -> list[dict]:
        """The trunks over the turn at ``depth``: each ends at a mark."""
        encode = _encoding(tokenizer, pattern).encode_ordinary
        found, start, turns = [], 0, _turns(row)
        for mark in (m for m in row["marks"] or () if m < depth):
            found.append({"block_id": row["keys"][mark], "tokens": sum(len(encode(x)) for t in turns[start : mark + 1] for x in turn_parts(*t))})
            start = mark + 1
        return found

    def build(table: pa.Table) -> pa.Table:
        encode = _encoding(tokenizer, pattern).encode_ordinary
        table = table.sort_by([(c, "ascending") for c in ("trunk", "share", "unit", "conv_id", "place")])
        group, out, tree, held, over, at = table.column("group")[0].as_py(), [], Tree(), 0, [], None

        def close() -> None:
            nonlocal tree, held
            if tree.leaves:
                out.append({"block_id": f"{group}-{len(out)}", "above": over, **tree.emit(encode, sum(a["tokens"] for a in over))})
            tree, held = Tree(), 0

        for row in (r for b in table.to_batches(max_chunksize=64) for r in b.to_pylist()):
            # Blocks end between subtrees, never inside one.
            if at is None or row["trunk"] != at[0] or row["unit"] != at[1] and held > block_chars:
                close()
                over = above(row, row["depth"]) if at is None or row["trunk"] != at[0] else over
            elif row["unit"] == at[1] == "" and held > block_chars:
                close()
            at = row["trunk"], row["unit"]
            turns = _turns(row)[row["depth"] :]
            tree.add(row["conv_id"], turns)
            held += 32 + sum(len(t) + 32 for _, t in turns)
        close()
        return pa.Table.from_pylist(out, _BLOCK)

    def trunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer, pattern).encode_ordinary
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                tree, over = Tree(), above(row, row["depth"])
                start = max((m + 1 for m in row["marks"] if m < row["depth"]), default=0)
                tree.add(None, _turns(row)[start : row["depth"] + 1])
                own = tree.emit(encode, sum(a["tokens"] for a in over)) | {"conversations": []}
                yield pa.RecordBatch.from_pylist([{"block_id": row["keys"][row["depth"]], "above": over, **own}], _BLOCK)

    examples = on_path.groupBy("key", "depth").agg(F.min("leaf").alias("leaf"))
    leaves = materialize(examples.select("leaf").distinct(), "leaves")
    turns = skew_join(whole.select("leaf", "turns", "keys"), leaves, ["leaf"]).dropDuplicates(["leaf"])
    marked = examples.select("leaf", "depth").join(deep.select("leaf", "marks"), "leaf")
    trunk_blocks = turns.join(marked, "leaf").select("depth", "marks", "turns", "keys").mapInArrow(trunks, BLOCK)
    return dealt.groupBy("group").applyInArrow(build, BLOCK).unionByName(trunk_blocks)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Read:
    """What has been read on the way to a node: digests that go on from those of the node before."""

    __slots__ = ("turns", "digest", "loss_chars", "loss", "chars", "tokens")

    def __init__(self, before: _Read | None = None):
        if before is None:
            self.turns = self.loss_chars = self.chars = self.tokens = 0
            self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        else:
            for name in ("turns", "loss_chars", "chars", "tokens"):
                setattr(self, name, getattr(before, name))
            self.digest, self.loss = before.digest.copy(), before.loss.copy()

    def then(self, formatted: str, learned: str, tokens: int) -> _Read:
        after = _Read(self)
        ((role, text),) = parse(formatted)
        learned = unescape(learned)
        after.digest.update(f"{role}\n{text}\n".encode())
        after.loss.update(learned.encode())
        after.turns, after.loss_chars, after.chars, after.tokens = self.turns + 1, self.loss_chars + len(learned), self.chars + len(formatted), self.tokens + tokens
        return after


def read_back(formatted: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """What each conversation of ``blocks`` holds, decoded from its tokens: digests of its turns and of what is learned.

    Every node is decoded once. Position ids and attended intervals must add up to what stands before a node, or it is an
    error. No blocks give no rows.
    """
    whole = materialize(formatted.select(*_BLOCK.names), "blocks")
    held = whole.where(F.size("conversations") > 0)
    refs = materialize(held.select("block_id", F.posexplode("above").alias("at", "trunk")).select("block_id", "at", F.col("trunk.block_id").alias("key")), "refs")
    nodes = F.transform("nodes", lambda n: F.struct(n["start"].alias("start"), n["end"].alias("end"), n["loss_start"].alias("loss_start"), n["loss_end"].alias("loss_end")))
    trunk = whole.where(F.size("conversations") == 0).select(F.col("block_id").alias("key"), F.struct("token_ids", nodes.alias("nodes")).alias("trunk"))
    context = skew_join(refs, trunk, ["key"]).groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("at", "trunk"))).alias("context"))
    free = held.where(F.size("above") == 0)
    rows = held.where(F.size("above") > 0).join(context, "block_id").unionByName(free.withColumn("context", F.array().cast(context.schema["context"].dataType)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lambda ids: _encoding(tokenizer, pattern).decode_bytes(ids).decode()
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            base = _Read()
            for t in row["context"]:
                ids = t["trunk"]["token_ids"]
                for on in t["trunk"]["nodes"]:
                    base = base.then(decode(ids[on["start"] : on["end"]]), decode(ids[on["loss_start"] : on["loss_end"]]), on["end"] - on["start"])
            if base.tokens != sum(a["tokens"] for a in row["above"]):
                raise ValueError("a block's trunks aren't what it names")
            ids, done = row["token_ids"], []
            for on in row["nodes"]:
                before = done[on["parent"]] if on["parent"] >= 0 else base
                attended = base.tokens + sum(a["end"] - a["start"] for a in on["attends"])
                if not before.tokens == attended == row["position_ids"][on["start"]]:
                    raise ValueError("a node doesn't attend to what stands before it")
                done.append(before.then(decode(ids[on["start"] : on["end"]]), decode(ids[on["loss_start"] : on["loss_end"]]), on["end"] - on["start"]))
            found = []
            for c in row["conversations"]:
                end = done[c["leaf"]] if c["leaf"] >= 0 else base
                found.append((c["conv_id"], end.turns, end.digest.hexdigest(), end.loss_chars, end.loss.hexdigest(), end.chars))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in READ_BACK.split(", ")])

    return rows.mapInArrow(read, READ_BACK)
