"""Canonical keys of whole actions.

Two actions that differ in nothing but a label share a key: their arguments,
environment, outputs and the files of arguments that they name are brought into
canonical form, and the rest of their input tree counts by its content.

``actions[action, root]``, ``args[action, pos, token]``, ``env[action, name,
value]``, ``outputs[action, pos, path]``; ``files[root, path, hash]`` is the flat
input tree (a symbolic link's hash says where it leads) and ``contents[hash,
content]`` has the argument files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelake.functions.expressions import normalize_token
from cachelake.operators import trees

ROUNDS = 2


def normalize_argsfile(content: Column) -> Column:
    """A file of arguments in canonical form, line by line; a carriage return
    stays where it is."""

    def line(x: Column) -> Column:
        ends = x.endswith("\r")
        plain = F.when(ends, F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)
        return F.concat(normalize_token(plain), F.when(ends, F.lit("\r\n")).otherwise(F.lit("\n")))

    return F.array_join(F.transform(F.split(content, "\n"), line), "")


def argsfiles(actions: DataFrame, args: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """``action, round, pos, line, path, hash``: the files that arguments name
    by ``@path``, and those that these name in a line of their own, in the
    order in which they are met; ``hash`` is null where the input tree or its
    content lacks one.  What files of the second round name isn't followed.

    A file's references are found once, whatever number of actions name it.
    """
    known = contents.select("hash", "content").dropDuplicates(["hash"])
    named = known.select("hash", F.posexplode(F.split("content", "\n")).alias("line", "text")).select("hash", F.col("line").alias("_line"), F.regexp_extract("text", r"^\s*@(.*?)\s*$", 1).alias("_path"), F.col("text").rlike(r"^\s*@").alias("_is")).where("_is").drop("_is")
    have = files.join(known.select("hash").distinct(), "hash", "left_semi").select("root", "path", "hash").dropDuplicates(["root", "path"])
    asked = args.where(F.col("token").startswith("@")).join(actions.select("action", "root"), "action").select("action", "root", F.lit(1).alias("round"), "pos", F.lit(-1).alias("line"), F.substring("token", 2, 1 << 30).alias("path"))
    found = []
    for n in range(ROUNDS):
        met = asked.join(have, ["root", "path"], "left").select("action", "root", "round", "pos", "line", "path", "hash")
        found.append(met.drop("root"))
        if n + 1 < ROUNDS:
            asked = met.where("hash is not null").join(named, "hash").select("action", "root", F.lit(n + 2).alias("round"), "pos", F.col("_line").alias("line"), F.col("_path").alias("path"))
    return found[0].unionByName(found[1])


def source_digests(actions: DataFrame, files: DataFrame, reached: DataFrame) -> DataFrame:
    """``action, source``: a digest of each action's input tree without the
    argument files that it reaches (by exact path).

    Actions with one root and the same files left out share a digest, which is
    made once, by a hash tree: an input tree may be of any size.
    """
    left_out = reached.groupBy("action").agg(F.array_sort(F.collect_set("path")).alias("left_out"))
    each = actions.select("action", "root").join(left_out, "action", "left").withColumn("left_out", F.coalesce("left_out", F.array().cast("array<string>")))
    each = each.withColumn("group", F.sha2(F.concat_ws("\0", F.lit("r"), "root", F.array_join("left_out", "\0")), 256))
    sets = each.select("group", "root", "left_out").dropDuplicates(["group"])
    kept = files.join(sets, "root").where(~F.expr("array_contains(left_out, path)")).select("group", "path", "hash")
    digests = trees.roots(trees.hash_tree(kept)).withColumnRenamed("fp", "source")
    return each.join(digests, "group", "left").select("action", F.coalesce("source", F.lit("")).alias("source"))


def canonical_keys(actions: DataFrame, args: DataFrame, env: DataFrame, outputs: DataFrame, files: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keys[action, key]`` and ``failed[action, path]``: an action that names
    an argument file which can't be had has no key.

    A key is a digest over parts that say what they are, so an argument that
    moves to the environment makes another key.  Of files only digests move to
    the actions; an action's parts, bounded by its command, meet once.
    """
    reached = argsfiles(actions, args, files, contents)
    failed = reached.where("hash is null").select("action", "path").distinct()
    whole = contents.dropDuplicates(["hash"]).select("hash", F.sha2(normalize_argsfile(F.col("content")), 256).alias("text"))

    def part(df: DataFrame, n: int, kind: str, text: Column, *order: Column) -> DataFrame:
        nth = [F.lit(0).cast("long")] * (3 - len(order)) + [o.cast("long") for o in order]
        return df.select("action", F.struct(F.lit(n).alias("n"), *[o.alias(f"o{i}") for i, o in enumerate(nth)], F.concat(F.lit(f"{kind}:"), text, F.lit("\0")).alias("text")).alias("part"))

    parts = [
        part(args, 0, "argument", normalize_token("token"), F.col("pos")),
        part(env, 1, "environment", F.concat("name", F.lit("="), normalize_token("value"))),
        part(outputs, 2, "output", normalize_token("path"), F.col("pos")),
        part(reached.join(whole, "hash"), 3, "file", F.col("text"), F.col("round"), F.col("pos"), F.col("line")),
        part(source_digests(actions, files, reached.where("hash is not null")), 4, "source", F.col("source")),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    lists = every.groupBy("action").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    keys = lists.join(failed.select("action").distinct(), "action", "left_anti")
    return keys.select("action", F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), ""), 256).alias("key")), failed
