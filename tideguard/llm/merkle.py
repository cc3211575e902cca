"""Merkle manifest of a dataset: root, proofs and verification by cogrouped subtree exchange.

Leaves are digests of whole rows, in order per language. Every FAN consecutive nodes have the
digest of their digests as parent, until one is left: the language's subroot; the subroots in the
order of the languages make the root in the same way.

Leaves go by superblock, FAN**LEVELS consecutive ones of a language. On the way up each superblock is
reduced to one node, the nodes of superblocks to superblocks again, and so on: a handful of passes,
each over a small part of the one before. On the way down the nodes that a superblock lacks, the
siblings on the way from its top to the root, are cogrouped with its own nodes, and one call finishes
what remains: it reduces the nodes again, joins inner and outer siblings to a proof per node and
folds it. Nothing but digests moves, a group has at most a superblock's rows and one row of outer nodes,
and the driver sees one number per table (how many layers there are).

Defined cases: a null value is `-`, so null and empty differ. Leaves with the same language and
doc_id are ordered by digest; equal rows then stand next to each other and each has its own
proof. A null doc_id comes first. Texts of any length are digested in the scan. An empty table
gives an empty result. Columns other than doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import numbered
from tideguard.session import materialise

FAN = 8
# Levels of a superblock, which so has up to FAN**LEVELS nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVEL = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """Digest of a row of documents with `text` as its text."""
    parts = [field(text if c == "text" else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, group, leaf, and `other`: the leaf with text `changed` where `tampered`, else null."""
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(
        F.col("doc_id"), group.alias("grp"), leaf_of(F.col("text")).alias("leaf"),
        F.when(tampered, leaf_of(changed)).alias("other"),
    )


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _reduced(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of a superblock of `height` levels from its nodes up to its top.

    The last level is one node. With other superblocks beside it (more nodes in all, `n`, than it
    holds), all levels are built however few nodes it has; alone, as many as it takes.
    """
    levels = [nodes]
    while len(levels) <= height if n > FAN**height else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[dict[str, str]]:
    """Digests before and after a node and its ancestors among their siblings, lowest first."""
    out = []
    for level in levels[:-1]:
        start = at - at % FAN
        out.append({"before": "".join(level[start:at]), "after": "".join(level[at + 1 : start + FAN])})
        at //= FAN
    return out


def _folded(digest: str, siblings) -> str:
    for level in siblings:
        digest = _digest(level["before"] + digest + level["after"])
    return digest


def _nodes(group: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]]]:
    group = group.sort_values("idx")
    return group, _reduced([bytes(d).hex() for d in group["digest"]], int(group["n"].iloc[0]), height)


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """One node per superblock: the next layer."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group, levels = _nodes(group, height)
        first = group.iloc[0]
        return pd.DataFrame({
            "grp": [first["grp"]], "idx": [int(first["idx"]) // FAN**height], "n": [-(-int(first["n"]) // FAN**height)],
            "digest": [bytes.fromhex(levels[-1][0])],
        })

    keys = [F.col("grp"), F.expr(f"idx div {FAN**height}").alias("_block")]
    read = nodes.select("grp", "idx", "n", "digest")
    return read.groupBy(*keys).applyInPandas(top, "grp string, idx long, n long, digest binary")


def _exchanged(nodes: DataFrame, outer: DataFrame, height: int, finish, schema: str) -> DataFrame:
    """`finish(nodes of a superblock, its levels, its row of outer nodes)` for every superblock."""

    def call(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, levels = _nodes(inner, height)
        return finish(group, levels, above.iloc[0])

    block = F.expr(f"idx div {FAN**height}")
    left = nodes.groupBy("grp", block.alias("_block"))
    return left.cogroup(outer.groupBy("grp", F.col("idx").alias("_block"))).applyInPandas(call, schema)


OUTER = f"grp string, idx long, levels array<{LEVEL}>, subroot string, root string"


def _outer_of_each(group: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
    """The outer nodes of every node: its siblings here, then those of its superblock."""
    outer = [dict(level) for level in above["levels"]]
    return pd.DataFrame({
        "grp": group["grp"], "idx": group["idx"],
        "levels": [_siblings(levels, i) + outer for i in range(len(group))],
        "subroot": above["subroot"], "root": above["root"],
    })


def _layers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """`nodes`, the tops of their superblocks, the tops of those, up to one node per group."""
    layers = [nodes]
    while (layers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        layers.append(materialise(_tops(layers[-1], height), "merkle-up"))
    return layers


def _outer(layers: list[DataFrame], top: DataFrame, down_to: int, height: int) -> DataFrame:
    """Outer nodes of the nodes of layer `down_to`, from the row(s) `top` above the last layer."""
    outer = top
    for nodes in reversed(layers[down_to:]):
        outer = materialise(_exchanged(nodes, outer, height, _outer_of_each, OUTER), "merkle-down")
    return outer


def manifest(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """Proofs of the stored table `rows` (doc_id, grp, leaf, other): one row per leaf.

    leaf, subroot, root, the siblings before and after on the way up (`levels`, lowest first),
    proof_sha256 (their digest), folded_root (from `other` where there is one, else the leaf, and the
    original siblings) and verified.
    """
    ordered = materialise(numbered(rows, ["grp"], ["doc_id", "leaf"]), "merkle-leaves")
    layers = _layers(ordered.withColumn("digest", F.col("leaf")), height)
    subroots = layers[-1].where("n = 1").select(F.col("grp").alias("lang"), "digest")
    subroots = materialise(subroots.withColumn("grp", F.lit("")), "merkle-subroots")
    langs = materialise(numbered(subroots, ["grp"], ["lang"]), "merkle-langs")
    lang_layers = _layers(langs, height)
    nothing = F.from_json(F.lit("[]"), f"array<{LEVEL}>")
    root = lang_layers[-1].select(
        "grp", F.lit(0).cast("long").alias("idx"), nothing.alias("levels"),
        F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"),
    )
    above = _outer(lang_layers, root, 0, height)
    per_lang = langs.join(above.drop("grp", "subroot"), "idx").select(
        F.col("lang").alias("grp"), F.lit(0).cast("long").alias("idx"), "levels",
        F.lower(F.hex("digest")).alias("subroot"), "root",
    )
    outer = _outer(layers, per_lang, 1, height)

    def finish(group: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        outer, out = [dict(level) for level in above["levels"]], []
        for i, (doc, other) in enumerate(zip(group["doc"], group["other"], strict=True)):
            path = _siblings(levels, i) + outer
            leaf = levels[0][i]
            proof = _digest("".join(level["before"] + level["after"] for level in path))
            changed = leaf if other is None else bytes(other).hex()
            out.append((doc, leaf, above["subroot"], above["root"], path, proof, _folded(changed, path)))
        names = ["doc", "leaf", "subroot", "root", "levels", "proof_sha256", "folded_root"]
        return pd.DataFrame(out, columns=names)

    # As text: pandas would turn whole numbers with nulls among them into floating point.
    named = ordered.select("grp", "idx", "n", F.col("leaf").alias("digest"), "other", F.col("doc_id").cast("string").alias("doc"))
    schema = f"doc string, leaf string, subroot string, root string, levels array<{LEVEL}>, proof_sha256 string, folded_root string"
    out = _exchanged(named, outer, height, finish, schema)
    return out.select(
        F.col("doc").cast(rows.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root",
        "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "levels",
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_manifest(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """`manifest` of `docs`; every third (by CRC 32 of doc_id) is checked with its text in lower case.

    A null doc_id has no CRC: its row is not tampered with.
    """
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = leaves(docs, F.coalesce(third, F.lit(False)), lower_ascii(F.col("text")))
    return manifest(materialise(rows, "merkle-digests"), height)
