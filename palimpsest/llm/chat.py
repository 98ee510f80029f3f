"""Reply trees to training conversations: root-to-leaf paths by joins of the replies with themselves, branches ranked by
score, and each chosen path formatted, with control strings escaped and a loss mask over the assistant's texts."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

ASSISTANT = "assistant"
#: The template's marks (fixed): around an assistant's text, and around another role's name, line end and text.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
#: Strings that no text may hold as they are.
CONTROL = (OPEN, CLOSE, ASK, ASKED, "<<SYS>>", "<</SYS>>")


def node_key(*parts: Column) -> Column:
    """A key of 128 bits of some columns, nulls told from texts: each is written with its length before it."""
    texts = (p.cast("string") for p in parts)
    return F.left(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256), F.lit(32))


def replies(trees: DataFrame, score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, texts) of trees (tree_id, node_id, parent_id, role, text and maybe a score): what tree_paths and formatted take."""
    key, parent = node_key(F.col("tree_id"), F.col("node_id")), node_key(F.col("tree_id"), F.col("parent_id"))
    worth = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    links = trees.select("tree_id", key.alias("node"), F.when(F.col("parent_id").isNotNull(), parent).alias("parent"), worth.alias("score"))
    links = links.groupBy("node").agg(F.min("tree_id").alias("tree_id"), F.min("parent").alias("parent"), F.max("score").alias("score")).withColumn("copies", F.lit(1).cast("long"))
    return links, trees.select(key.alias("node"), "role", "text")


def chains(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, texts) of conversations (conv_id, turn, role, text): each row replies to the one before it by turn, then role
    and a digest of the text; rows alike in all are one node with copies. Only keys are sorted, not texts."""
    key = node_key(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    found = turns.select("conv_id", "turn", "role", key.alias("node")).groupBy("conv_id", "turn", "role", "node").agg(F.count("*").alias("copies"))
    before = F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn", "role", "node"))
    links = found.select(F.col("conv_id").alias("tree_id"), "node", before.alias("parent"), F.lit(0.0).alias("score"), "copies")
    return links, turns.select(key.alias("node"), "role", "text")


def tree_paths(links: DataFrame, keep: int | None = None) -> DataFrame:
    """tree_id, leaf, rank, score, pos (from 0 at the root), node, copies: the nodes of each chosen path from a root to a leaf,
    which leaf numbers.

    links: tree_id, node (unique), parent (null, or of no node: a root), score, copies. A leaf's path has the sum of its
    nodes' scores; a tree's leaves are ranked by it, from 1, ties by their keys, and the first keep (all, if None) are
    chosen. Nodes on a cycle, or below one, have no root and lie on no path.

    Joins with itself double the way: after join k a node knows its ancestor 2^k steps up and the sum of scores on the way,
    or else how far its root is, and takes no part in further joins; so a tree of depth D takes log2(D) joins, not D, and
    only the deepest nodes are in the last ones. A chosen path is then halved
    down: of a stretch longer than 2^k nodes the upper part begins at that ancestor. Every join is by a unique key, so its
    rows are those of the paths, at most.
    """
    # numbers instead of keys: rows of the joins are a few bytes; they are stable once they are written
    links = staged(links.select("tree_id", "node", "parent", "score", "copies", F.monotonically_increasing_id().alias("id")), "links")
    numbers = links.select(F.col("node").alias("parent"), F.col("id").alias("up"))
    at = staged(links.join(numbers, "parent", "left").select("id", "up", "score"), "up0")
    # what still goes up, 2^k steps so far, and what has found its root
    goes, most, levels = at.where("up is not null").select("id", "up", F.col("score").alias("sum")), links.count(), []
    rooted = at.where("up is null").select("id", F.lit(0).cast("long").alias("steps"), "score")
    while not goes.isEmpty() and (full := 1 << len(levels)) <= most:  # what goes on for longer goes round
        levels.append(goes)
        both = staged(goes.join(goes.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum")), "up", "left"), f"up{len(levels)}")
        goes = both.where("_up is not null").select("id", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"))
        ends = both.where("_up is null").join(rooted.select(F.col("id").alias("up"), F.col("steps").alias("_steps"), F.col("score").alias("_score")), "up")
        rooted = rooted.unionByName(staged(ends.select("id", (F.col("_steps") + full).alias("steps"), (F.col("sum") + F.col("_score")).alias("score")), "rooted"))
    leaves = rooted.join(at.select(F.col("up").alias("id")).where("id is not null"), "id", "left_anti")
    leaves = leaves.join(links.select("id", "tree_id", "node"), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "node")))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    ranked = staged(ranked.select("tree_id", F.col("id").alias("leaf"), "rank", "score", "steps"), "chosen")
    part = ranked.select("leaf", F.col("leaf").alias("id"), F.col("steps").alias("pos"), (F.col("steps") + 1).alias("n"))
    for k in reversed(range(len(levels))):
        full = 1 << k
        up = levels[k].select("id", F.col("up").alias("_up"))
        whole = F.struct("id", "pos", "n")
        lower = F.struct("id", "pos", F.lit(full).cast("long").alias("n"))
        upper = F.struct(F.col("_up").alias("id"), (F.col("pos") - full).alias("pos"), (F.col("n") - full).alias("n"))
        split = part.join(up, "id", "left").select("leaf", F.explode(F.when(F.col("n") > full, F.array(lower, upper)).otherwise(F.array(whole))).alias("x"))
        part = split.select("leaf", "x.*")
    return part.join(links.select("id", "node", "copies"), "id").join(ranked.drop("steps"), "leaf").select("tree_id", "leaf", "rank", "score", "pos", "node", "copies")


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """text without control strings: backslashes are doubled, and one is put behind the first character of each control string."""
    inner = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({inner})", r"$1\\")


def unescaped(text: str) -> str:
    return text if "\\" not in text else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def formatted(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """paths with piece, loss_from and loss_to: a path's conversation is its pieces one after another, by pos, each written
    copies times. loss_from and loss_to (null: nothing) say which code points of the piece the loss counts.

    An assistant's text stands between <s> and </s>; another role's name, a line end and its text between [INST] and
    [/INST]. Nulls count as empty. In a name a line end becomes \\n too. A conversation stays a run of pieces, so that none
    has to fit in a row or a task; documents() joins those that do.
    """
    texts = texts.groupBy("node").agg(F.min("role").alias("role"), F.min("text").alias("text"))  # rows of one key are alike
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    ours = role == ASSISTANT
    name = F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))
    piece = F.when(ours, F.concat(F.lit(OPEN), text, F.lit(CLOSE))).otherwise(F.concat(F.lit(ASK), name, F.lit("\n"), text, F.lit(ASKED)))
    made = texts.select("node", piece.alias("piece"), ours.alias("_ours"))
    span = F.char_length("piece")
    return paths.join(made, "node").select(*[c for c in paths.columns if c != "node"], "piece", F.when(F.col("_ours"), F.lit(len(OPEN))).alias("loss_from"), F.when(F.col("_ours"), span - len(CLOSE)).alias("loss_to"))


def documents(pieces: DataFrame) -> DataFrame:
    """tree_id, leaf, rank, score, text, loss (array of (from, to) in code points): conversations each as one text."""
    rows = pieces.groupBy("tree_id", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "loss_from", "loss_to", "copies"))).alias("_p"))
    each = F.flatten(F.transform("_p", lambda p: F.array_repeat(p, p["copies"].cast("int"))))
    spans = F.aggregate(
        each, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.char_length(p["piece"])).alias("at"), F.when(p["loss_from"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + p["loss_from"]).alias("from"), (s["at"] + p["loss_to"]).alias("to"))))).alias("out")),
    )["out"]
    return rows.select("tree_id", "leaf", "rank", "score", F.array_join(F.transform(each, lambda p: p["piece"]), "").alias("text"), spans.alias("loss"))


_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.DOTALL)


def turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text; an error if anything is left over."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        out.append((ASSISTANT, unescaped(m[1])) if m[1] is not None else (unescaped(m[2]), unescaped(m[3])))
        at = m.end()
    return out


def read_back(pieces: DataFrame) -> DataFrame:
    """tree_id, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, out of its pieces.

    The digests run on through a conversation, so its pieces meet in one task, sorted, and none is held but the one at
    hand: memory doesn't grow with a conversation's length.
    """
    ddl = "tree_id long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    @lean
    def run(batches):
        own, rows, state = None, [], None
        for batch in batches:
            for tree, leaf, piece, a, b, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if leaf != own:
                    if own is not None:
                        rows.append(closed(state))
                    own, state = leaf, [tree, leaf, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                said = turns(piece)
                told = "".join(f"{r}\n{t}\n" for r, t in said).encode()
                learnt = unescaped(piece[a:b]) if a is not None else ""
                state[2] += len(said) * copies
                state[4] += len(learnt) * copies
                state[6] += len(piece) * copies
                for _ in range(copies):
                    state[3].update(told)
                    state[5].update(learnt.encode())
            if len(rows) >= 10_000:
                yield table(rows)
                rows = []
        if own is not None:
            rows.append(closed(state))
        yield table(rows)

    def closed(s):
        return [s[0], s[1], s[2], s[3].hexdigest(), s[4], s[5].hexdigest(), s[6]]

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ddl.split(", ")])

    ordered = pieces.repartition("leaf").sortWithinPartitions("leaf", "pos")
    return ordered.select(F.col("tree_id").cast("long").alias("tree_id"), "leaf", "piece", "loss_from", "loss_to", "copies").mapInArrow(run, ddl)


def chat_format(conversations: DataFrame) -> DataFrame:
    """The pieces (see formatted) of conversations (conv_id, turn, role, text), each a tree without branches.

    Rows go by turn (null first), rows of one turn by role and a digest of role and text; rows that repeat are turns one by
    one. Null roles and texts count as empty; rows without conv_id are one conversation without id. Conversations without
    rows, and empty tables, give nothing. Other columns are not looked at.
    """
    links, texts = chains(conversations.select("conv_id", "turn", "role", "text"))
    return formatted(tree_paths(links), texts)
