"""Exact duplicates by Patricia-trie owners.

Every task first inserts the normalised bytes of its own rows into a compressed radix
trie; a terminal node keeps its owner (most code points, then smallest id) and the ids of
its members.  When the trie outgrows its budget, its largest subtrees are sent on and
forgotten: a spill that goes to the shuffle instead of a disk.  So a text that a third of
all rows hold leaves each task a few times at most, however often it occurs there.

Then the terminal nodes, without their members, travel to the partition of their length
and 16 bits of their content's hash, and all texts of a partition are inserted into one
trie.  There are as many partitions as their tries need to stay within the budget.  Should
one outgrow it all the same, its largest subtrees are spilled: their place in the trie is
marked, their nodes, and all texts that later arrive at the mark, are left for another
round over more partitions.  A round always completes some texts of each partition, so the
rounds end.  Equality is decided by the bytes on a path of a trie and by nothing else.

Members meet their group's owner by the number of their own node, in rows of ``MEMBERS``
ids that are unpacked afterwards, so no task gathers a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, text

#: Bytes that one task's trie holds, about, before subtrees are sent on.
TRIE_BYTES = 64 << 20
#: Ids in one row between the passes; a larger group travels as several rows.
MEMBERS = 4096
#: What a node takes beside its bytes, about.
NODE_BYTES = 500
WHITE = b" \t\n\x0b\x0c\r"


class Node:
    __slots__ = ("label", "children", "value", "spilled")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.spilled = label, {}, value, False


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and what follows ``at`` in ``key``, by bisection over slices."""
    low, high = 0, min(len(label), len(key) - at)
    if key.startswith(label[:high], at):
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Byte strings in a compressed radix tree; no edge's label is a prefix of its sibling's."""

    def __init__(self):
        self.root = Node(b"")
        self.first: bytes | None = None

    def terminal(self, key: bytes) -> Node | None:
        """The node where ``key`` ends, made if need be; None where its subtree was spilled."""
        if self.first is None:
            self.first = key
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = leaf = Node(key[at:])
                return leaf
            if child.spilled:
                return None
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = _common(child.label, key, at)
            fork = Node(child.label[:k])
            child.label = child.label[k:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            node, at = fork, at + k
        return node

    def items(self, node: Node | None = None, head: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """Keys and values of a subtree."""
        stack = [(head, node or self.root)]
        while stack:
            head, node = stack.pop()
            key = head + node.label
            if node.value is not None:
                yield key, node.value
            stack.extend((key, child) for child in node.children.values())

    def weights(self, weigh) -> dict[int, int]:
        """Bytes of every subtree, by its root's identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        out: dict[int, int] = {}
        for node in reversed(order):
            out[id(node)] = len(node.label) + NODE_BYTES + (weigh(node.value) if node.value is not None else 0) + sum(out[id(c)] for c in node.children.values())
        return out

    def spill(self, budget: int, weigh, keep_mark: bool) -> tuple[list[tuple[bytes, object]], int]:
        """Cuts off the largest subtrees until ``budget`` bytes are left: their items, and the bytes that are left.

        The path of the first key stays.  With ``keep_mark``, what later leads into a subtree that was cut off is told.
        """
        size = self.weights(weigh)
        total, out = size[id(self.root)], []
        # along the first key's path: all other children are subtrees to choose from
        choice, node, at, head = [], self.root, 0, b""
        while True:
            inner = self.first[at] if at < len(self.first) else None
            choice += [(size[id(c)], k, node, head) for k, c in node.children.items() if k != inner and not c.spilled]
            if inner is None or (nxt := node.children.get(inner)) is None or nxt.spilled:
                break
            node, at = nxt, at + len(nxt.label)
            head = self.first[:at]
        for weight, k, parent, head in sorted(choice, key=lambda c: c[:2], reverse=True):
            if total <= budget:
                break
            child = parent.children.pop(k)
            out += self.items(child, head)
            total -= weight
            if keep_mark:  # one byte is enough: all keys that go on with it were in this subtree
                parent.children[k] = mark = Node(child.label[:1])
                mark.spilled = True
        return out, total


def normalised(whole: bytes) -> bytes:
    return whole.translate(None, WHITE)


def _rank(n_cp: int, doc_id) -> tuple:
    """Smaller is better: most code points, then smallest id, null last."""
    return -n_cp, doc_id is None, 0 if doc_id is None else doc_id


def _node_schema(kind: T.DataType, carried: T.StructType | None) -> T.StructType:
    """A terminal node on its way: ``text`` normalises to its key; ``uids`` are the first pass's nodes that it stands for."""
    fields = [("text", T.BinaryType()), ("size", T.LongType()), ("bucket", T.IntegerType()), ("sha", T.StringType()), ("uid", T.LongType()), ("best", kind), ("best_cp", T.LongType()), ("n", T.LongType()), ("uids", T.ArrayType(T.LongType())), ("members", T.ArrayType(kind)), ("final", T.BooleanType())]
    return T.StructType([T.StructField(*f) for f in fields + ([("carried", carried)] if carried else [])])


class _Out:
    """Rows collected into batches of bounded size."""

    def __init__(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.weight = to_arrow_schema(schema), [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.weight += len(row[0] or b"") + 8 * (len(row[8] or ()) + len(row[9] or ())) + 100

    def batch(self, least: int = 0):
        import pyarrow as pa

        if self.rows and self.weight >= least:
            rows, self.rows, self.weight = self.rows, [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


class _Value:
    """Of a terminal node: its owner, its number of rows and, as the pass needs them, members or nodes."""

    __slots__ = ("rank", "uid", "best", "cp", "n", "ids", "text", "carried", "at", "sha")

    def weigh(self) -> int:
        return 40 * len(self.ids) + len(self.text or b"")


def _owners(batches, budget: int, schema, carry: list[str]):
    """First pass: terminal nodes of the task's own rows.

    The owner stands first among its members; rows after a group's first one, which
    only carry more members, have no owner (``best_cp`` -1).
    """
    import pyarrow.compute as pc
    from pyspark import TaskContext

    context = TaskContext.get()
    uid = (context.partitionId() if context else 0) << 40
    trie, total, out = PatriciaTrie(), 0, _Out(schema)

    def packed(items):
        nonlocal uid
        for key, v in items:
            uid += 1
            size, head = len(key), (v.text if carry else key, len(key), int(v.sha[:4], 16), v.sha, uid, v.best, v.cp, v.n, [uid])
            if carry:
                out.add(*head, [], False, v.carried)
            else:
                members = v.ids
                members[0], members[v.at] = members[v.at], members[0]
                out.add(*head, members[:MEMBERS], False)
                for k in range(MEMBERS, len(members), MEMBERS):
                    out.add(None, size, 0, v.sha, uid, None, -1, 0, None, members[k : k + MEMBERS], False)
            yield from out.batch(8 << 20)

    for batch in batches:
        texts = text.utf8(batch.column("text"))
        ids, cps = batch.column("doc_id").to_pylist(), pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        kept = batch.select(carry).to_pylist() if carry else None
        null = batch.column("text").is_null().to_pylist()
        for k, (doc_id, n_cp, whole) in enumerate(zip(ids, cps, texts)):
            key = normalised(whole)
            node = trie.terminal(key)
            rank = (_rank(n_cp, doc_id), null[k], whole, str(kept[k])) if carry else _rank(n_cp, doc_id)
            if (v := node.value) is None:
                v = node.value = _Value()
                v.rank, v.n, v.ids, v.at, v.sha, v.text, v.carried = None, 0, [], 0, hashlib.sha256(key).hexdigest(), None, None
                total += len(key) + NODE_BYTES
            if v.rank is None or rank < v.rank:
                v.rank, v.best, v.cp, v.at = rank, doc_id, n_cp, v.n
                if carry:
                    total += len(whole) - len(v.text or b"")
                    v.text, v.carried = None if null[k] else whole, kept[k]
            v.n += 1
            if not carry:
                v.ids.append(doc_id)
                total += 40
        if total > budget:
            items, total = trie.spill(budget // 2, _Value.weigh, keep_mark=False)
            yield from packed(items)
            if total > budget:  # the rest is one path
                yield from packed(trie.items())
                trie, total = PatriciaTrie(), 0
    yield from packed(trie.items())
    yield from out.batch()


def _merged(batches, budget: int, schema, carry: list[str]):
    """A partition's trie: groups that are complete (``final``), and nodes of spilled subtrees."""
    trie, total, out = PatriciaTrie(), 0, _Out(schema)

    def packed(items, final: bool):
        for key, v in items:
            whole = v.text if carry else None if final else key
            for k in range(0, len(v.ids), MEMBERS):
                out.add(whole, len(key), int(v.sha[:4], 16), v.sha, v.uid, v.best, v.cp, v.n if final or not k else 0, v.ids[k : k + MEMBERS], None, final, *([v.carried] if carry else []))
                yield from out.batch(8 << 20)

    for batch in batches:
        for row in batch.to_pylist():
            whole = row["text"] or b""
            key = normalised(whole)
            v = _Value()
            v.rank, v.uid, v.best, v.cp, v.n, v.ids, v.sha = _rank(row["best_cp"], row["best"]), row["uid"], row["best"], row["best_cp"], row["n"], row["uids"], row["sha"]
            v.text, v.carried = (row["text"], row["carried"]) if carry else (None, None)
            v.rank = (v.rank, v.text is None, whole, str(v.carried)) if carry else (v.rank, v.uid)
            node = trie.terminal(key)
            if node is None:  # into a spilled subtree
                yield from packed([(key, v)], False)
                continue
            if node.value is None:
                node.value = v
                total += len(key) + NODE_BYTES + v.weigh()
                continue
            best, other = (v, node.value) if v.rank < node.value.rank else (node.value, v)
            best.n += other.n
            if not carry:  # where whole rows are kept, nobody asks for the nodes
                node.value.ids.extend(v.ids)
                best.ids = node.value.ids
            total += 8 * len(v.ids)
            node.value = best
        if total > budget:
            items, total = trie.spill(budget // 2, _Value.weigh, keep_mark=True)
            yield from packed(items, False)
    yield from packed(trie.items(), True)
    yield from out.batch()


def _groups(docs: DataFrame, budget: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first pass's nodes, and the complete groups."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    schema = _node_schema(kind, T.StructType([docs.schema[c] for c in carry]) if carry else None)
    owners = common.map_arrow(docs, lambda b: _owners(b, budget, schema, carry), schema)
    owners = common.stored(owners)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, done, spread = owners.where("best_cp >= 0").withColumn("members", F.lit(None).cast(schema["members"].dataType)), None, 2
    while True:
        n, weight = left.agg(F.count("*"), F.sum(F.col("size") + 2 * NODE_BYTES)).first()
        if done is not None and not n:
            if carry:
                common.forget(owners)  # the groups hold whole rows
            return owners, done
        # no more partitions than nodes
        parts = max(least, min(n, spread * (weight or 0) // budget))
        merged = common.map_arrow(left.repartition(parts, "size", "bucket"), lambda b: _merged(b, budget, schema, carry), schema)
        merged = common.stored(merged)
        final = merged.where("final")
        done = final if done is None else done.unionByName(final)
        left, spread = merged.where("NOT final"), 2 * spread


def exact_duplicates(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are compared after deleting ASCII white space; a null text is an empty one.
    Of a group, the row with the most code points stays, then the smallest id, a null
    id last; of rows that are the same in both, exactly one.  Ids are of any type that
    has an order.  An empty table gives an empty result; columns other than doc_id and
    text are ignored.
    """
    owners, groups = _groups(docs.select("doc_id", "text"), budget, [])
    groups = groups.select(F.explode("uids").alias("uid"), F.col("uid").alias("keep_uid"), F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    # a node has one group, and a row for every MEMBERS of its members; only the owner's node's first row, whose best_cp is given, holds the owner
    members = owners.select("uid", "sha", "members", (F.col("best_cp") >= 0).alias("_head"))
    rows = members.join(groups, "uid").select("*", F.posexplode("members").alias("at", "doc_id"))
    kept = F.col("_head") & (F.col("uid") == F.col("keep_uid")) & (F.col("at") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_documents(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows travel once, in the tries' terminal nodes: nothing is joined.  Of rows that are
    the same in length and id, the smallest text stays, then the smallest of the other
    columns as they are written.
    """
    carry = [c for c in docs.columns if c != "text"]
    _, groups = _groups(docs, budget, carry)
    return groups.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(whole) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
