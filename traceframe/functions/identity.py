"""Content-addressed identities: short hashes of canonical JSON built from columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

IDENTITY_SCHEMA = "traceframe-identity/1"
DEFAULT_PRESENCE_SCOPE = "mlx_window"  # fixed value: the scope that leaves an id unchanged

Tree = Mapping[str, "Column | Tree"]


def not_empty(value: Column) -> Column:
    """An array or map column with empty treated as absent, as the canonical form requires."""
    return F.when(F.size(value) > 0, value)


def ascii_json(text: Column) -> Column:
    """JSON text with all but printable ASCII as ``\\uxxxx``, outside the basic plane as two of them."""
    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c.rlike("[^ -~]"), F.regexp_replace(units, "(.{4})", "\\\\u$1")).otherwise(c)

    def lower_hex(json: Column) -> Column:
        """Escapes of control characters with small digits; a backslash before one makes it plain text."""
        for letter in "ABCDEF":
            json = F.regexp_replace(json, r"(?<!\\)((?:\\\\)*\\u00[01])" + letter, "$1" + letter.lower())
        return json

    places = F.sequence(F.lit(1), F.length(text))
    every = F.array_join(F.transform(places, lambda i: escaped(F.substr(text, i, F.lit(1)))), "")
    wide = F.when(text.rlike("[^ -~]"), every).otherwise(text)
    return F.when(text.rlike(r"\\u00[01][A-F]"), lower_hex(wide)).otherwise(wide)


def json_number(text: Column) -> Column:
    """A number in Java's scientific notation (``1.25E-5``) as JSON writers print it: fixed from 1e-4 to 1e16, else ``1.25e-05``."""
    def parts(p: Column) -> Column:
        sign, exponent = F.when(text.startswith("-"), "-").otherwise(""), F.get(p, 1).cast("int")
        digits = F.regexp_replace(F.get(p, 0), r"[-.]|\.?0*$", "")
        return F.struct(sign.alias("sign"), digits.alias("digits"), exponent.alias("exponent"))

    def written(x: Column) -> Column:
        digits, e = x["digits"], x["exponent"]
        size = F.length(digits)
        point = F.when(size > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(digits)
        scientific = F.concat(point, F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        whole = F.when(size <= e + 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).otherwise(
            F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, size)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.concat(x["sign"], F.when((e >= 16) | (e < -4), scientific).when(e >= 0, whole).otherwise(small))

    return F.when(text.contains("E"), bind(bind(F.split(text, "E"), parts), written)).otherwise(text)


def _respelled(json: Column) -> Column:
    """JSON text with its strings in ASCII and its numbers in their usual notation, token by token."""
    def numbers(part: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(part, F.lit(r"[-0-9.E]+|[^-0-9.E]+"), F.lit(0)), json_number), "")

    def token(t: Column) -> Column:
        return F.when(t.startswith('"'), ascii_json(t)).when(t.contains("E"), numbers(t)).otherwise(t)

    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]+'), F.lit(0))
    return F.array_join(F.transform(tokens, token), "")


def _struct(tree: Tree) -> Column:
    """The tree as a struct with sorted fields, for one pass of the JSON writer; empty nested objects are null."""
    def nested(sub: Tree) -> Column:
        return F.when(F.coalesce(*_leaves(sub), F.lit(None)).isNotNull(), _struct(sub))

    return F.struct(*[(v if isinstance(v, Column) else nested(v)).alias(k) for k, v in sorted(tree.items())])


def _leaves(tree: Tree) -> list[Column]:
    return [leaf for v in tree.values() for leaf in ([F.when(v.isNotNull(), True)] if isinstance(v, Column) else _leaves(v))]


def canonical_json(tree: Tree) -> Column:
    """JSON object text with sorted keys, in ASCII; null entries and empty nested objects are left out.

    The JSON writer's text is taken as it is where it can hold nothing that is
    written differently: escapes, characters beyond ASCII, scientific notation.
    Else it is respelled, floats in their shortest decimal form.  Floating
    columns must be rounded (``canonical_float``) and array or map columns
    wrapped in ``not_empty`` by the caller.
    """
    return bind(F.to_json(_struct(tree)), lambda j: F.when(j.rlike(r"[^ -~]|\\|[0-9]E"), _respelled(j)).otherwise(j))


def canonical_float(value: Column) -> Column:
    return F.bround(value.cast("double"), 6)


def content_id(tree: Tree, prefix: str, schema: str = IDENTITY_SCHEMA, length: int = 12) -> Column:
    digest = F.sha2(F.concat(F.lit(schema + "\n"), canonical_json(tree)), 256)
    return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, length))


def _unless(drop: Column, value: Column) -> Column:
    return F.when(~F.coalesce(drop, F.lit(False)), value)


def decoding_tree(policy: Mapping[str, Column]) -> dict[str, Column]:
    """Identity part of a decoding policy: no seed, no inactive penalties, default scope left out."""
    out = {k: v for k, v in policy.items() if k != "seed"}

    def inactive(name: str) -> Column:
        value = policy.get(name, F.lit(None).cast("double"))
        return value.isNull() | (value == 0)

    quiet = inactive("presence_penalty")
    scope = F.coalesce(policy.get("presence_scope", F.lit(DEFAULT_PRESENCE_SCOPE)), F.lit(DEFAULT_PRESENCE_SCOPE))
    default_scope = scope == DEFAULT_PRESENCE_SCOPE
    rules = {
        "presence_penalty": quiet,
        "presence_context_size": quiet | ~default_scope,
        "presence_scope": quiet | default_scope,
        "frequency_penalty": inactive("frequency_penalty"),
        "frequency_context_size": inactive("frequency_penalty"),
    }
    if "repetition_penalty" in policy:
        neutral = policy["repetition_penalty"].isNull() | (policy["repetition_penalty"] == 1.0)
        rules |= {"repetition_penalty": neutral, "repetition_context_size": neutral}
    return {k: _unless(rules[k], v) if k in rules else v for k, v in out.items()}


def condition_id(policy: Mapping[str, Column], schema: str = IDENTITY_SCHEMA) -> Column:
    return content_id(decoding_tree(policy), "cond", schema)


def presentation_id(task_id: Column, prompt_policy: Column, prompt: Column, schema: str = IDENTITY_SCHEMA) -> Column:
    return content_id(
        {"structural_task_id": task_id, "prompt_policy": prompt_policy, "prompt_sha256": F.sha2(prompt, 256)},
        "pres", schema,
    )


def trial_id(task_id: Column, presentation: Column, policy: Mapping[str, Column], seed: Column, repeat: Column,
             schema: str = IDENTITY_SCHEMA) -> Column:
    tree = {"task_id": task_id, "presentation_id": presentation, "condition": {**policy, "seed": seed},
            "seed": seed, "repeat": repeat}
    return content_id(tree, "trial", schema)


def draw_id(task_id: Column, presentation: Column, policy: Mapping[str, Column], seed: Column,
            schema: str = IDENTITY_SCHEMA) -> Column:
    tree = {"task_id": task_id, "presentation_id": presentation, "condition": decoding_tree(policy), "seed": seed}
    return content_id(tree, "draw", schema)


def task_hash_id(*fields: Column) -> Column:
    """First 16 hex digits of the sha256 of the ``|``-joined fields; null counts as empty."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def prefix_digest(ids: Column, length: Column | None = None) -> Column:
    """sha256 of the compact JSON list of the first ``length`` ids (all when not given)."""
    kept = ids if length is None else F.slice(ids, F.lit(1), length)
    return F.sha2(F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")), 256)


def population_key(spec: Mapping[str, Column], families: Column, default_families: Column,
                   schema: str = IDENTITY_SCHEMA) -> Column:
    """Key of the fields that define a population; an empty family list means all families."""
    chosen = F.when(F.size(families) > 0, F.array_sort(families)).otherwise(F.array_sort(default_families))
    return content_id({**spec, "families": not_empty(chosen)}, "pop", schema)
