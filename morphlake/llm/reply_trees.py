"""Reply trees as chat-formatted conversations.

Messages point at the message they answer. Root-to-leaf paths are enumerated by self-joins that double
their reach: a first row of joins gives each message its ancestor 1, 2, 4, ... steps up, with the sum
of the scores on the way, until all have met their roots; a second one walks the same tables from the
longest step to the shortest and so reaches each ancestor of a chosen leaf once. The number of joins
grows with the logarithm of the depth, and no task holds more than a path. Branches are ranked by
their scores, and each chosen path becomes one conversation.

A message whose parent is unknown is a root; of a circle the smallest message is made one. Copies of an
id are siblings, of which the first (by role, text and score) gets the answers. A null id is answered by
none. Null scores count as zero, null roles and texts as empty. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fresh_path, remove_at_exit

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that are put in order together; longer conversations are linked bucket by bucket.
SPAN = 1024
#: Values of the loss mask: the texts of this role.
LEARNED = "assistant"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Without ``<|``: one more backslash in every run of them between ``<`` and ``|``."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str | None, str | None]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans (start, end) in code points under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role or '')}\n", escape(text or "")
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece[: -len(END)].partition("\n")
        out.append((_unescape_role(role), unescape(text)))
    return out


def linked(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """node, parent (a node or null), conv_id, role, text and score of messages (conv_id, msg_id, parent_id, role, text, score)."""
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(0.0)
    rows = messages.select(F.monotonically_increasing_id().alias("node"), "conv_id", "msg_id", "parent_id", "role", "text", F.coalesce(score, F.lit(0.0)).alias("score"))
    rows = scratch.write(rows, "messages")
    # The key of a message is a struct, so a null conversation is one of its own.
    heads = rows.where("msg_id is not null").groupBy(F.struct("conv_id", "msg_id").alias("key")).agg(F.min_by("node", F.struct("role", "text", "score", "node")).alias("parent"))
    wanted = rows.where("parent_id is not null").select("node", F.struct("conv_id", F.col("parent_id").alias("msg_id")).alias("key"))
    links = wanted.join(heads, "key").select("node", "parent")
    return rows.join(links, "node", "left").select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "conv_id", "role", "text", "score")


def chained(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes as in :func:`linked` of plain conversations (conv_id, turn, role, text): each row answers the one before.

    Rows go by turn, equal turns by role and text, null turns first. A conversation is put in order
    bucket by bucket of SPAN turns, so one that holds most of the rows is not sorted by one task.
    """
    score = F.col("score").cast("double") if "score" in turns.columns else F.lit(0.0)
    rows = turns.select(F.monotonically_increasing_id().alias("node"), "conv_id", "turn", "role", "text", F.coalesce(score, F.lit(0.0)).alias("score"))
    rows = scratch.write(rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62)))), "turns")
    order = F.struct("turn", "role", "text", "node")
    ends = rows.groupBy("conv_id", "bucket").agg(F.max_by("node", order).alias("last"), F.min_by("node", order).alias("node"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("bucket"))).where("before is not null").select("node", "before")
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text", "node")
    links = rows.withColumn("parent", F.lag("node").over(inside)).join(ends, "node", "left")
    return links.select("node", F.coalesce("parent", "before").alias("parent"), "conv_id", "role", "text", "score")


def climb(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Totals (node, total, size) over the way from each node to its root, and the steps (node, up) of 1, 2, 4, ... .

    Nodes of a circle never meet a root; each circle is cut above its smallest node and climbed again.
    """
    cut = None
    while True:
        parent = F.col("parent") if cut is None else F.when(F.col("cut").isNull(), F.col("parent"))
        base = nodes if cut is None else nodes.join(cut.withColumn("cut", F.lit(True)), "node", "left")
        reach = scratch.write(base.select("node", parent.alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("size"), F.col("node").alias("least")), "reach")
        steps, n = [], nodes.count()
        while not (live := reach.where("up is not null")).isEmpty() and 1 << len(steps) <= 2 * n:
            steps.append(live.select("node", "up"))
            far = reach.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("size").alias("size2"), F.col("least").alias("least2"))
            longer = live.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("size") + F.col("size2")).alias("size"), F.least("least", "least2").alias("least"))
            reach = scratch.write(longer.unionByName(reach.where("up is null")), "reach")
        round_ = reach.where("up is not null")
        if round_.isEmpty():
            return reach.select("node", "total", "size"), steps
        # All nodes are on a circle or below one; after so many steps the node above is on it.
        on = round_.select(F.col("up").alias("node")).distinct()
        new = round_.join(on, "node", "left_semi").where("node = least").select("node")
        cut = scratch.write(new if cut is None else cut.unionByName(new), "cut")


def paths(nodes: DataFrame, best: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """leaf, conv_id, rank, branch_score and ``turns``, the array of (role, text) from the root, of every
    root-to-leaf path, or of the ``best`` ones of each conversation: by the sum of the scores of their
    messages, equal ones by the order of their leaves."""
    scratch = scratch or Scratch()
    nodes = scratch.write(nodes, "nodes")
    totals, steps = climb(nodes, scratch)
    parents = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    inner = steps[0].select(F.col("up").alias("node")).distinct() if steps else parents  # without the links that were cut
    leaves = nodes.select("node", "conv_id").join(inner, "node", "left_anti").join(totals, "node")
    place = Window.partitionBy("conv_id").orderBy(F.desc("total"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(place))
    leaves = leaves.where(F.col("rank") <= best) if best is not None else leaves
    leaves = scratch.write(leaves.select(F.col("node").alias("leaf"), "conv_id", "rank", F.col("total").alias("branch_score")), "leaves")
    walk = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up_by"))
    for k in reversed(range(len(steps))):
        both = F.array(F.struct("node", "up_by"), F.struct(F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by")))
        walk = walk.join(steps[k], "node", "left").select("leaf", F.explode(both).alias("at")).select("leaf", "at.*").where("node is not null")
    texts = walk.join(nodes.select("node", "role", "text"), "node").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up_by")).alias("place"), "role", "text"))).alias("turns"))
    return leaves.join(texts, "leaf").withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_paths(chosen: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, leaf, rank, branch_score, ``formatted`` and ``loss_spans`` of the paths of :func:`paths`."""
    kind = chosen.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], learned) for turns in batch["turns"].to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "leaf", "rank", "branch_score")), pa.array([x for x, _ in done], pa.string()), spans], names=["conv_id", "leaf", "rank", "branch_score", "formatted", "loss_spans"])

    rows = bounded_batches(chosen.select("conv_id", "leaf", "rank", "branch_score", "turns"))
    return rows.mapInArrow(run, f"conv_id {kind}, leaf bigint, rank int, branch_score double, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _written(build) -> DataFrame:
    scratch = Scratch()
    out = build(scratch)
    path = fresh_path(out.sparkSession, "conversations")
    out.write.parquet(path)
    remove_at_exit(out.sparkSession, path)
    scratch.clear()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The ``best`` branches (None: all) of each conversation of (conv_id, msg_id, parent_id, role, text, score), formatted."""
    return _written(lambda scratch: format_paths(paths(linked(messages, scratch), best, scratch)))


def format_chains(turns: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text), each a tree of one branch, formatted."""
    return _written(lambda scratch: format_paths(paths(chained(turns, scratch), None, scratch)))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted conversations."""
    from hashlib import sha256

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = bounded_batches(formatted.select("conv_id", "formatted", "loss_spans"))
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
