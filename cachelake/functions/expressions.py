"""Column expressions of digests, ranges, tokens and stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
NORM_ROOT = "__norm__/"
PATH_RULE = r"^(?:[^/]*/)*?(__[^/]+__)(?:/(?:[0-9a-f]{16}|output_artifacts|aquery_placeholder))?(?:/(.*))?$"
LIB_SUFFIX = r"-[0-9a-f]{8}\."


def digit(column: str | Column) -> Column:
    """A hash's first hex digit, in lower case."""
    return F.lower(F.substring(column, 1, 1))


def owned_digits(shard: int, of: int = 8) -> list[str]:
    """The hex digits that ``shard`` of ``of`` owns: equal runs of the 16."""
    if not 0 <= shard < of or 16 % of:
        raise ValueError(f"no shard {shard} of {of}")
    per = 16 // of
    return [f"{d:x}" for d in range(shard * per, (shard + 1) * per)]


def owner_shard(column: str | Column, of: int = 8) -> Column:
    """The shard that owns a hash; null for text that isn't hex."""
    return F.floor(F.conv(digit(column), 16, 10).cast("int") / F.lit(16 // of)).cast("int")


def is_digest(column: str | Column) -> Column:
    """64 hex digits of either case."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike("^[0-9a-fA-F]{64}$")


def parse_resource(column: str | Column) -> Column:
    """``…/<hash>/<size>`` as a struct (hash, size); null parts if malformed."""
    c = F.col(column) if isinstance(column, str) else column
    ok = c.rlike(r"(^|/)[0-9a-fA-F]{64}/[0-9]+(/|$)")
    rule = r"(?:^|/)([0-9a-fA-F]{64})/([0-9]+)(?:/|$)"
    return F.when(ok, F.struct(F.regexp_extract(c, rule, 1).alias("hash"), F.regexp_extract(c, rule, 2).try_cast("bigint").alias("size")))


def normalize_path(column: Column) -> Column:
    """Strip what is particular to a label from a path, if it has such a part."""
    rule = "(?s)" + PATH_RULE
    tail = F.regexp_extract(column, rule, 2)
    moved = F.concat(F.lit(NORM_ROOT), F.regexp_extract(column, rule, 1), F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(""))
    return F.when(column.rlike(rule), moved).otherwise(column)


def normalize_token(column: str | Column) -> Column:
    """The canonical form of one command token (rules in first-match order)."""
    whole = F.col(column) if isinstance(column, str) else column
    marks = F.regexp_extract(whole, "^(@*)", 1)
    token = F.regexp_replace(whole, "^@+", "")
    suffix = lambda c: F.regexp_replace(c, LIB_SUFFIX, "-00000000.")
    remap = F.regexp_extract(token, "^--remap-path-prefix=([^=]*)", 1)
    name = F.regexp_extract(token, "(?s)^--path-env=([^=]*)=(.*)$", 1)
    value = F.regexp_extract(token, "(?s)^--path-env=([^=]*)=(.*)$", 2)
    plain = (
        F.when(token.startswith("-Cmetadata="), F.lit("-Cmetadata=__CKEY__"))
        .when(token.startswith("-Cextra-filename="), F.lit("-Cextra-filename=-00000000"))
        .when(token.startswith("--buck-target="), F.lit("--buck-target=__CKEY__"))
        .when(token.startswith("--remap-path-prefix="), F.concat(F.lit("--remap-path-prefix="), normalize_path(remap), F.lit("=__norm__/")))
        .when(token.rlike("(?s)^--path-env=[^=]*="), F.concat(F.lit("--path-env="), name, F.lit("="), suffix(normalize_path(value))))
        .otherwise(suffix(normalize_path(token)))
    )
    return F.concat(marks, plain)


def strip_result(paths: Column) -> Column:
    """A result's output paths as they are stored: in canonical form."""
    return F.transform(paths, normalize_token)


def served_metadata(metadata: Column) -> Column:
    """The execution metadata (a struct with ``worker``) of a served result: a
    placeholder worker where it was dropped before storing."""
    return F.coalesce(metadata, F.struct(F.lit("unknown").alias("worker")))


def command_key(tokens: Column) -> Column:
    """The canonical key of a whole command: the digest of all its tokens
    (arguments, env values, lines of argsfiles) in their order, each in
    canonical form and ended by a NUL."""
    return F.sha2(F.array_join(F.transform(tokens, lambda x: F.concat(normalize_token(x), F.lit("\0"))), ""), 256)


def group_key(first_output: Column, input_root: Column) -> Column:
    """What actions are kept together by: the label part of the first output
    path, else the input root."""
    label = F.regexp_extract(F.coalesce(first_output, F.lit("")), "^(.*?__/)", 1)
    return F.when(label != "", label).otherwise(input_root)


def role_of(name: Column) -> Column:
    """The role in a row bank's name: what follows the last ``-ac-``."""
    return F.when(name.contains("-ac-"), F.regexp_extract(name, "^.*-ac-(.*)$", 1))


def role_order(role: Column) -> Column:
    """Roles in apply order: the driver's rows come last."""
    return F.when(role == "driver", F.lit("zzzz-driver")).otherwise(role)


def epoch_seconds(stamp: Column) -> Column:
    """RFC 3339 text as epoch seconds; malformed text is null, never old."""
    ok = (F.length(stamp) >= 19) & (F.substring(stamp, 11, 1) == "T")
    return F.when(ok, F.unix_timestamp(F.try_to_timestamp(stamp)))


def generation_gate(seed: Column) -> Column:
    """The part of a generation's name that its seed decides."""
    return F.substring(F.sha2(seed, 256), 1, 8)


def bloom_bits(entries: int) -> int:
    """Bits of a summary of so many entries: 12 each, as a power of two."""
    return 1 << (max(entries, 64) * 12 - 1).bit_length()


def bloom_positions(column: str | Column, nbits: int, k: int = 4) -> Column:
    """The ``k`` bit positions of a hash: its 8-digit groups, masked."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array(*[F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(nbits - 1)) for i in range(k)])
