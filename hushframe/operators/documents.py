"""Nested documents: list their leaves, mask them by path, rewrite them.

Typed columns (struct, array, map) are walked by their schema. Documents without a schema are JSON text or
VARIANT: one function turns each into a flat list of leaves, the rules run over that list, and the values are put
back, so the plan is the same for any depth. Paths join keys by `.` and add `[]` per array level.

Nothing that should be masked passes unread: a text that begins like a document but cannot be read (broken, or more
than `MAX_DEPTH` levels) goes through content detection as plain text, or is replaced as a whole if there is none;
`doc_state` flags it, and strict mode stops the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import inline_rows, let, lowered, partial_mask
from hushframe.operators import columns as cols
from hushframe.operators.detect import FOUND, found_texts, mask_text, masked_texts
from hushframe.operators.json_docs import MAX_DEPTH, SECRET, filled, rebuilt, secrets_hidden, walked
from hushframe.operators.outcomes import FIELD_RULE, RECOGNIZER, looked_at, no_outcomes, of_detection, outcome
from hushframe.plans.policy import (
    REDACTED,
    ColumnPolicy,
    PathLabel,
    Policy,
    kind_of,
    overlay_rules,
    resolve_labels,
)

__all__ = ["MAX_DEPTH", "SECRET", "depth_guard", "doc_mask", "doc_replace", "doc_state", "doc_walk", "json_depth", "secret_manifest_mask"]

LEAVES = "array<struct<path:string,key:string,value:string,is_key:boolean>>"

_STRINGS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _join(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _last_segment(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, ".", -1), r"\[\]$", "")


def json_depth(text: Column) -> Column:
    """How many containers are open at the deepest point of a JSON text."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, _STRINGS, ""), r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("top"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["open"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(marks, start, step, lambda acc: acc["top"])


def _text_of(df: DataFrame, doc_col: str) -> Column:
    col = F.col(doc_col)
    return col if isinstance(df.schema[doc_col].dataType, T.StringType) else F.to_json(col)


def _walk_column(df: DataFrame, doc_col: str, max_depth: int = MAX_DEPTH) -> Column:
    """A VARIANT may be a bare value; a text that is one is plain text."""
    return walked(_text_of(df, doc_col), max_depth, scalars=isinstance(df.schema[doc_col].dataType, T.VariantType))


def depth_guard(df: DataFrame, doc_col: str, max_depth: int = MAX_DEPTH, strict: bool = False) -> DataFrame:
    """Add `too_deep`; in strict mode such a document stops the job."""
    deep = F.coalesce(json_depth(_text_of(df, doc_col)) - 1 > max_depth, F.lit(False))
    if strict:
        deep = F.when(deep, F.raise_error(F.lit("document nesting exceeds limit")).cast("boolean")).otherwise(deep)
    return df.withColumn("too_deep", deep)


def doc_state(df: DataFrame, doc_col: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Add `doc_state`: json, text (plain text), broken (begins like a document), deep, or null."""
    return df.withColumn("doc_state", _walk_column(df, doc_col, max_depth)["state"])


def _leaf(path: Column, key: Column, value: Column, is_key: bool) -> Column:
    return F.struct(
        path.alias("path"), key.alias("key"), value.alias("value"), F.lit(is_key).alias("is_key")
    )


def _no_leaves() -> Column:
    return F.array().cast(LEAVES)


def _has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_variant(kind.valueType)
    return isinstance(kind, T.VariantType)


def _through_json(kind: T.DataType) -> bool:
    """A part of a typed document that is walked as JSON: a VARIANT, or a collection with one inside."""
    return isinstance(kind, T.VariantType) or isinstance(kind, (T.ArrayType, T.MapType)) and _has_variant(kind)


def _plain_leaves(found: Column) -> Column:
    """The string values and keys of a walk, in the shape of LEAVES."""
    some = F.filter(found["leaves"], lambda x: x["kind"].isin("key", "string"))
    return F.transform(
        some,
        lambda x: F.struct(x["path"].alias("path"), x["key"].alias("key"), x["value"].alias("value"), (x["kind"] == "key").alias("is_key")),
    )


def _typed_leaves(node: Column, kind: T.DataType, path: Column, at: str = "") -> Column | None:
    """Leaves of a typed node; None for a type that holds none."""
    if isinstance(kind, T.StringType):
        own = F.array(_leaf(path, _last_segment(path), node, False))
        return F.when(node.isNull(), _no_leaves()).otherwise(own)
    if _through_json(kind):
        return F.coalesce(_plain_leaves(walked(F.to_json(node), prefix=at, scalars=True)), _no_leaves())
    if isinstance(kind, T.ArrayType):
        inner = F.concat(path, F.lit("[]"))
        if _typed_leaves(F.lit(None), kind.elementType, inner) is None:
            return None
        parts = F.transform(node, lambda x: _typed_leaves(x, kind.elementType, inner))
        return F.coalesce(F.flatten(parts), _no_leaves())
    if isinstance(kind, T.MapType):

        def entry(e: Column) -> Column:
            own = F.array(_leaf(path, e["key"], e["key"], True))
            below = _typed_leaves(e["value"], kind.valueType, _join(path, e["key"]))
            return own if below is None else F.concat(own, below)

        return F.coalesce(F.flatten(F.transform(F.map_entries(node), entry)), _no_leaves())
    if isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            key = F.lit(f.name)
            parts.append(F.array(_leaf(path, key, key, True)))
            below = _typed_leaves(node.getField(f.name), f.dataType, _join(path, key), f"{at}.{f.name}" if at else f.name)
            if below is not None:
                parts.append(below)
        return F.when(node.isNull(), _no_leaves()).otherwise(F.concat(*parts) if parts else _no_leaves())
    return None


def _raise_unread(state: Column) -> Column:
    """Stops the job for a text that begins like a document and cannot be read."""
    why = F.when(state == "deep", F.lit("document nesting exceeds limit")).otherwise(F.lit("document cannot be read"))
    return F.when(state.isin("deep", "broken"), F.raise_error(why).cast("boolean")).otherwise(F.lit(True))


def doc_walk(df: DataFrame, id_col: str, doc_col: str, max_depth: int = MAX_DEPTH, strict: bool = False) -> DataFrame:
    """Every string value and every key of each document: id, path, key, value, is_key.

    A struct names all its fields as keys. A bare JSON string is one leaf without a path. Text that cannot be read has no leaves (`doc_state` tells it), or stops
    the job when strict.
    """
    kind = df.schema[doc_col].dataType
    if isinstance(kind, (T.StringType, T.VariantType)):
        df = df.select(id_col, walked(_text_of(df, doc_col), max_depth, scalars=True, plain=True).alias("_walked"))
        if strict:
            df = df.filter(_raise_unread(F.col("_walked.state")))
        rows = inline_rows(df, [id_col], F.col("_walked.leaves"), "kind")
        return rows.select(id_col, "path", "key", "value", (F.col("kind") == "key").alias("is_key"))
    leaves = _typed_leaves(F.col(doc_col), kind, F.lit(""))
    return inline_rows(df, [id_col], _no_leaves() if leaves is None else leaves, "is_key")


# --- masking -------------------------------------------------------------------------------------


class _LeafRules:
    """The layers of a policy for leaves whose path is only known per row or per schema.

    `detected` is a map from the texts of a document to what content detection makes of them; without it every
    leaf carries the patterns itself. With `counted` the map has entries of `found_texts`.
    """

    def __init__(self, policy: Policy, detected: Column | None = None, counted: bool = False):
        self.policy = policy
        self.overlay = overlay_rules(policy.overlay)
        self.roles = {r: overlay_rules(rules) for r, rules in (policy.role_rules or {}).items() if r} if policy.role_col else {}
        self.labels = resolve_labels(policy.labels, policy.object_id)
        self.detected = detected
        self.counted = counted

    def _detect(self, value: Column) -> Column:
        if self.policy.detection is None:
            return value
        if self.detected is None:
            return mask_text(value, self.policy.detection)
        found = F.try_element_at(self.detected, value)
        return F.coalesce(found["text"] if self.counted else found, value)

    def by_name(self, value: Column, name: str) -> Column:
        """Overlay rules of a name that is known while planning."""
        if self.roles:
            return cols.role_value(value, name, F.col(self.policy.role_col), self.overlay, self.roles)
        return cols.overlay_value(value, self.overlay[name.lower()]) if name.lower() in self.overlay else value

    def _label_for(self, path: str, key: str) -> PathLabel | None:
        return cols.find_label(self.labels, path, key, self.policy.strict_match_mode)

    def at(self, value: Column, path: str, key: str, kind: T.DataType) -> Column:
        """A leaf with a path known from the schema."""
        if not isinstance(kind, T.StringType):
            label = self._label_for(path, key)
            if label is None:
                return value
            c = ColumnPolicy(key, kind, True, False, kind_of(kind))
            return cols.profile_value(value, c, label.profile)
        out = value
        for layer in self.policy.order:
            if layer == "detection":
                out = self._detect(out)
            elif layer == "overlay":
                out = self.by_name(out, key)
            elif layer == "labels":
                label = self._label_for(path, key)
                if label is not None:
                    c = ColumnPolicy(key, kind, True, True, None)
                    out = cols.profile_value(out, c, label.profile)
        return out

    def _by_overlay(self, value: Column, key: Column) -> Column:
        def chosen(rules, partial: bool) -> Column:
            out = F.when(F.lit(False), value)
            for name, rule in rules.items():
                token = F.when(value.isNotNull(), F.lit(rule.token))
                out = out.when(lowered(key) == name, cols.overlay_value(value, rule) if partial else token)
            return out.otherwise(value)

        if not self.roles:
            return chosen(self.overlay, True)
        out = F.when(F.lit(False), value)
        for role, rules in self.roles.items():
            out = out.when(F.col(self.policy.role_col) == role, chosen(rules, False))
        return out.otherwise(chosen(self.overlay, True))

    def _profile(self, path: Column, key: Column) -> Column:
        """Profile of the label in force, null when there is none."""
        return self._in_force(path, key, lambda l: l.profile)

    def _in_force(self, path: Column, key: Column, part: Callable[[PathLabel], str]) -> Column:
        if not self.labels:
            return F.lit(None).cast("string")
        by_path = [x for l in self.labels.values() for x in (F.lit(l.field_path), F.lit(part(l)))]
        loose = [
            l
            for l in self.labels.values()
            if l.match_mode == "key_any_depth" or not self.policy.strict_match_mode
        ]
        by_key = [x for l in loose for x in (F.lit(l.field_path), F.lit(part(l)))]
        exact = F.try_element_at(F.create_map(*by_path), path)
        if not by_key:
            return exact
        return F.coalesce(exact, F.try_element_at(F.create_map(*by_key), lowered(F.trim(key))))

    def _by_label(self, value: Column, path: Column, key: Column) -> Column:
        return let(
            F.struct(self._profile(path, key).alias("p"), value.alias("v")),
            lambda s: F.when(s["p"].isNull() | (s["p"] == "do_not_mask"), s["v"])
            .when(s["p"] == "partial_mask", partial_mask(s["v"]))
            .otherwise(F.lit(REDACTED)),
        )

    def text(self, value: Column, path: Column, key: Column) -> Column:
        """A string leaf with a path that is data."""
        out = value
        for layer in self.policy.order:
            if layer == "detection":
                out = self._detect(out)
            elif layer == "overlay" and (self.overlay or self.roles):
                out = self._by_overlay(out, key)
            elif layer == "labels" and self.labels:
                out = self._by_label(out, path, key)
        return out

    def counts(self, leaves: Column) -> Column:
        """Outcomes of masking leaves (path, key, value, kind), by the layers in their order; those that only looked are
        one outcome with their number. No layer makes a value null or a null a value."""
        parts, done = [], []

        def before(leaf: Column) -> Column:
            out, text = leaf["value"], leaf["kind"] == "string"
            for layer in done:
                new = self._detect(out) if layer == "detection" else self._by_overlay(out, leaf["key"])
                out = F.when(text, new).otherwise(out)
            return out

        def found(leaf: Column) -> Column:
            return F.try_element_at(self.detected, leaf["value"])

        def spans(leaf: Column) -> Column:
            return F.transform(found(leaf)["spans"], lambda s: outcome(s["entity_type"], RECOGNIZER, 0, 1, s["size"]))

        def hit(leaf: Column, out: Column) -> Column:
            category = self._in_force(leaf["path"], leaf["key"], lambda l: l.category)
            return outcome(category, FIELD_RULE, 0, 1, F.octet_length(out.cast("string")))

        for layer in self.policy.order:
            if layer == "detection" and self.detected is not None:
                looked = F.filter(leaves, lambda x: (x["kind"] == "string") & F.coalesce(found(x)["looked"], F.lit(False)))
                parts.append(let(looked, lambda l: F.concat(looked_at(RECOGNIZER, F.size(l)), F.flatten(F.transform(l, spans)))))
                done.append(layer)
            elif layer == "overlay" and (self.overlay or self.roles):
                done.append(layer)
            elif layer == "labels" and self.policy.object_id:
                acts = lambda x: x["value"].isNotNull() & (F.coalesce(self._profile(x["path"], x["key"]), F.lit("do_not_mask")) != "do_not_mask")
                hits = F.transform(F.filter(leaves, acts), lambda x: hit(x, before(x)))
                parts.append(F.concat(looked_at(FIELD_RULE, F.size(F.filter(leaves, lambda x: x["value"].isNotNull()))), hits))
        return F.concat(*parts) if parts else no_outcomes()

    def typed(self, value: Column, path: Column, key: Column, zero: Column) -> Column:
        """A leaf that is not a string, with a path that is data."""
        if not self.labels:
            return value
        profile = self._profile(path, key)
        asked = profile.isNotNull() & (profile != "do_not_mask")
        return F.when(value.isNotNull() & asked, zero).otherwise(value)


def _mask_typed(node: Column, kind: T.DataType, path: str, rules: _LeafRules) -> Column:
    key = path.rsplit(".", 1)[-1].removesuffix("[]")
    if _through_json(kind):
        return _mask_as_json(node, kind, path, rules)
    if isinstance(kind, T.StructType):
        fields = [
            _mask_typed(
                node.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name, rules
            ).alias(f.name, metadata=f.metadata)
            for f in kind.fields
        ]
        return F.when(node.isNull(), node).otherwise(F.struct(*fields)) if fields else node
    if isinstance(kind, T.ArrayType):
        return F.transform(node, lambda x: _mask_typed(x, kind.elementType, f"{path}[]", rules))
    if isinstance(kind, T.MapType):
        return F.transform_values(node, lambda k, v: _mask_dynamic(v, kind.valueType, _join(F.lit(path), k), rules))
    if isinstance(kind, T.BinaryType):
        return node
    return rules.at(node, path, key, kind)


def _mask_dynamic(node: Column, kind: T.DataType, path: Column, rules: _LeafRules) -> Column:
    """Below a map the path depends on the row."""
    if isinstance(kind, T.StructType):
        fields = [
            _mask_dynamic(node.getField(f.name), f.dataType, _join(path, F.lit(f.name)), rules).alias(f.name)
            for f in kind.fields
        ]
        return F.when(node.isNull(), node).otherwise(F.struct(*fields)) if fields else node
    if isinstance(kind, T.ArrayType):
        inner = F.concat(path, F.lit("[]"))
        return F.transform(node, lambda x: _mask_dynamic(x, kind.elementType, inner, rules))
    if isinstance(kind, T.MapType):
        return F.transform_values(node, lambda k, v: _mask_dynamic(v, kind.valueType, _join(path, k), rules))
    if isinstance(kind, T.StringType):
        return rules.text(node, path, _last_segment(path))
    zero = cols.typed_placeholder(kind)
    return node if zero is None else rules.typed(node, path, _last_segment(path), zero)


def _new_values(leaves: Column, rules: _LeafRules) -> Column:
    """The leaves' values under the rules, in their order."""

    def new(x: Column) -> Column:
        value, path, key, kind = x["value"], x["path"], x["key"], x["kind"]
        return (
            F.when(kind == "string", rules.text(value, path, key))
            .when(kind == "number", rules.typed(value, path, key, F.lit("0")))
            .when(kind == "bool", rules.typed(value, path, key, F.lit("false")))
            .otherwise(value)
        )

    return F.transform(leaves, new)


def _mask_as_json(node: Column, kind: T.DataType, path: str, rules: _LeafRules) -> Column:
    text = F.to_json(node)
    found = walked(text, prefix=path, scalars=True)
    masked = rebuilt(found, _masked_leaves(found["leaves"], _strings(found["leaves"]), rules.policy))
    back = F.parse_json(masked) if isinstance(kind, T.VariantType) else F.from_json(masked, kind)
    return F.when(node.isNull(), node).otherwise(back)


def _strings(leaves: Column) -> Column:
    return F.transform(F.filter(leaves, lambda x: x["kind"] == "string"), lambda x: x["value"])


def _detected(texts: Column, policy: Policy) -> Column:
    """A map from distinct texts to what content detection makes of them: one copy of the patterns per document."""
    distinct = F.array_distinct(F.filter(texts, lambda x: x.isNotNull()))
    if policy.detection.detector is not None:
        return F.map_from_arrays(distinct, masked_texts(distinct, policy.detection))
    return let(distinct, lambda d: F.map_from_arrays(d, masked_texts(d, policy.detection)))


def _detects(policy: Policy) -> bool:
    return policy.detection is not None and "detection" in policy.order


def _masked_leaves(leaves: Column, texts: Column, policy: Policy) -> Column:
    """New values of a walk's leaves. What a function in Python made is an argument, never inside a lambda."""
    if not _detects(policy):
        return _new_values(leaves, _LeafRules(policy))
    both = F.struct(_detected(texts, policy).alias("detected"), leaves.alias("leaves"))
    return let(both, lambda b: _new_values(b["leaves"], _LeafRules(policy, b["detected"])))


def _rebuilt_if_changed(text: Column, found: Column, values: Column) -> Column:
    """The document with new values; the very text where no rule hit and no repeated key hides a value."""

    def shown(b: Column) -> Column:
        same = F.forall(F.zip_with(b["found"]["leaves"], b["new"], lambda x, v: x["value"].eqNullSafe(v)), lambda x: x)
        return F.when(same & b["found"]["once"], b["text"]).otherwise(rebuilt(b["found"], b["new"]))

    return let(F.struct(text.alias("text"), found.alias("found"), values.alias("new")), shown)


def doc_mask(df: DataFrame, doc_col: str, policy: Policy, max_depth: int = MAX_DEPTH, strict: bool | None = None) -> DataFrame:
    """Mask the leaves of a document column in place, each by its own path.

    JSON text comes back as JSON text and VARIANT as VARIANT, the very same where no rule hits; plain text, bare
    numbers and strings among it, only goes through content detection.
    Typed leaves (numbers, flags, times) change only when a confirmed label asks for it. A text that begins like a
    document and cannot be read is masked as plain text, or replaced without content detection; when `strict`
    (default: that of the detection) it stops the job.
    """
    kind, col = df.schema[doc_col].dataType, F.col(doc_col)
    if not isinstance(kind, (T.StringType, T.VariantType)):
        return cols.replace_columns(df, {doc_col: _mask_schema(col, kind, policy)})
    if strict is None:
        strict = policy.detection is not None and policy.detection.strict
    text = _text_of(df, doc_col)
    found = _walk_column(df, doc_col, max_depth)
    state, leaves = found["state"], found["leaves"]
    new = _rebuilt_if_changed(text, found, _masked_leaves(leaves, _strings(leaves), policy))
    if strict:
        unread = F.when(_raise_unread(state), text)
        unread = mask_text(unread, policy.detection) if _detects(policy) and policy.detection.detector is None else unread
    elif not _detects(policy):
        unread = F.when(state == "text", text).otherwise(F.lit(REDACTED))
    else:
        unread = F.get(masked_texts(F.array(F.when(state.isin("text", "broken", "deep"), text)), policy.detection), F.lit(0))
    if isinstance(kind, T.VariantType):
        masked = F.parse_json(F.when(state == "json", new).otherwise(F.lit(f'"{REDACTED}"')))
        masked = F.when(col.isNull(), col).when(_raise_unread(state), masked) if strict else F.when(col.isNull(), col).otherwise(masked)
    else:
        masked = F.when(state == "json", new).when(state == "null", text).otherwise(unread)
    return cols.replace_columns(df, {doc_col: masked})


def _mask_schema(col: Column, kind: T.DataType, policy: Policy) -> Column:
    """A document with a schema: its texts are gathered and detected once, then every leaf looks its own up."""
    leaves = _typed_leaves(col, kind, F.lit(""))
    if leaves is None or not _detects(policy):
        return _mask_typed(col, kind, "", _LeafRules(policy))
    if _has_variant(kind):
        if policy.detection.detector is not None:
            raise ValueError("a plugged-in detector cannot look into VARIANT parts of typed documents; give them a column of their own")
        return _mask_typed(col, kind, "", _LeafRules(policy))
    texts = F.transform(F.filter(leaves, lambda x: ~x["is_key"]), lambda x: x["value"])
    # The document is an argument too: optimized plans may put what computes it in its place.
    both = F.struct(_detected(texts, policy).alias("detected"), col.alias("doc"))
    return let(both, lambda b: _mask_typed(b["doc"], kind, "", _LeafRules(policy, b["detected"])))


def _all_leaves(node: Column, kind: T.DataType, path: Column, at: str = "") -> Column | None:
    """Every leaf that a rule can mask (path, key, value as text, kind); None for a type that holds none."""
    shape = "array<struct<path:string,key:string,value:string,kind:string>>"
    none = F.array().cast(shape)
    if _through_json(kind):
        found = walked(F.to_json(node), prefix=at, scalars=True)
        some = F.filter(found["leaves"], lambda x: x["kind"] != "key")
        return F.coalesce(F.transform(some, lambda x: F.struct(*[x[n].alias(n) for n in ("path", "key", "value", "kind")])), none)
    if isinstance(kind, T.StructType):
        parts = [
            _all_leaves(node.getField(f.name), f.dataType, _join(path, F.lit(f.name)), f"{at}.{f.name}" if at else f.name) for f in kind.fields
        ]
        parts = [p for p in parts if p is not None]
        return F.when(node.isNull(), none).otherwise(F.concat(*parts)) if parts else None
    if isinstance(kind, T.ArrayType):
        inner = F.concat(path, F.lit("[]"))
        if _all_leaves(F.lit(None), kind.elementType, inner, f"{at}[]") is None:
            return None
        return F.coalesce(F.flatten(F.transform(node, lambda x: _all_leaves(x, kind.elementType, inner, f"{at}[]"))), none)
    if isinstance(kind, T.MapType):
        if _all_leaves(F.lit(None), kind.valueType, path, at) is None:
            return None
        parts = F.transform(F.map_entries(node), lambda e: _all_leaves(e["value"], kind.valueType, _join(path, e["key"]), at))
        return F.coalesce(F.flatten(parts), none)
    if isinstance(kind, T.StringType):
        shown, name = node, "string"
    elif isinstance(kind, T.BinaryType) or cols.typed_placeholder(kind) is None:
        return None
    else:
        shown, name = node.cast("string"), "typed"
    leaf = F.struct(path.alias("path"), _last_segment(path).alias("key"), shown.alias("value"), F.lit(name).alias("kind"))
    return F.when(node.isNull(), none).otherwise(F.array(leaf)).cast(shape)


def _with_found(df: DataFrame, texts: Column, policy: Policy) -> DataFrame:
    """Adds `_found`, a map from distinct texts to what `found_texts` says of them, if content is detected."""
    if not _detects(policy):
        return df
    df = df.withColumn("_texts", F.array_distinct(F.filter(texts, lambda x: x.isNotNull())))
    return df.withColumn("_found", F.map_from_arrays("_texts", found_texts(F.col("_texts"), policy.detection)))


def doc_mask_counted(
    df: DataFrame, doc_col: str, policy: Policy, into: str, max_depth: int = MAX_DEPTH, strict: bool | None = None, only_counts: bool = False
) -> DataFrame:
    """`doc_mask`, with what masking the leaves looked at and masked appended to the array `into`.

    Texts and counts come from one list of leaves and one scan of its distinct texts. Text that is no document counts
    as one value without a path: content detection sees it, labels do not. With `only_counts` documents stay as they
    are, unless strict masking may stop the job.
    """
    kind, col = df.schema[doc_col].dataType, F.col(doc_col)
    if strict is None:
        strict = policy.detection is not None and policy.detection.strict
    detects = _detects(policy)
    rules = _LeafRules(policy, F.col("_found") if detects else None, counted=True)
    # What several expressions read is a column of its own: only columns are computed once and by compiled code.
    if not isinstance(kind, (T.StringType, T.VariantType)):
        leaves = _all_leaves(col, kind, F.lit(""))
        if leaves is None:
            return df
        if _has_variant(kind) and detects and policy.detection.detector is not None:
            raise ValueError("a plugged-in detector cannot look into VARIANT parts of typed documents; give them a column of their own")
        staged = df.withColumn("_leaves", leaves)
        staged = _with_found(staged, _strings(F.col("_leaves")), policy)
        staged = staged.withColumn("_counts", rules.counts(F.col("_leaves")))
        masked = _mask_schema(col, kind, policy) if _has_variant(kind) else _mask_typed(col, kind, "", rules)
    else:
        staged = df.withColumn("_text", _text_of(df, doc_col)).withColumn("_walked", _walk_column(df, doc_col, max_depth))
        walk, text, unread = F.col("_walked"), F.col("_text"), F.col("_unread")
        state, leaves = walk["state"], walk["leaves"]
        staged = staged.withColumn("_unread", F.when(state.isin("text", "broken", "deep"), text))
        staged = _with_found(staged, F.concat(_strings(leaves), F.array(unread)), policy)
        if detects:
            found = F.try_element_at("_found", unread)
            whole = F.coalesce(found["text"], unread)
            count = F.when(unread.isNotNull(), of_detection(found)).otherwise(no_outcomes())
        else:
            whole, count = F.when(state == "text", text).otherwise(F.lit(REDACTED)), no_outcomes()
        if strict:
            whole = F.when(_raise_unread(state), whole)
        if isinstance(kind, T.VariantType):
            whole = F.lit(f'"{REDACTED}"')
        staged = staged.withColumn("_own", F.filter(leaves, lambda x: x["kind"] != "key"))
        staged = staged.withColumn("_counts", F.when(state == "json", rules.counts(F.col("_own"))).otherwise(count))
        json = _rebuilt_if_changed(text, walk, _new_values(leaves, rules))
        masked = F.when(state == "json", json).when(state == "null", text).otherwise(whole)
        if isinstance(kind, T.VariantType):
            masked = F.when(col.isNull(), col).otherwise(F.parse_json(masked))
    new = {into: F.concat(into, "_counts")}
    if not only_counts or strict:
        new[doc_col] = masked
    return cols.replace_columns(staged, new).select(*[F.col(f"`{n}`") for n in df.columns])


# --- rewriting -----------------------------------------------------------------------------------


def _rename_keys(node: Column, where: Callable[[Column], Column], to: Callable[[Column], Column]) -> Column:
    """Rename matching keys of a map; a renamed key replaces an equal one, the last in key order wins."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(node),
            lambda e: F.struct(
                e["key"].alias("old"),
                F.when(where(e["key"]), to(e["key"])).otherwise(e["key"]).alias("key"),
            ),
        )
    )

    def winners(es: Column) -> Column:
        moved = F.filter(es, lambda e: e["old"] != e["key"])

        def wins(e: Column, i: Column) -> Column:
            later = F.slice(moved, 1, F.size(moved))
            rivals = F.filter(later, lambda m: (m["key"] == e["key"]) & (m["old"] != e["old"]))
            kept_still = e["old"] == e["key"]
            return F.when(kept_still, F.size(rivals) == 0).otherwise(
                F.size(F.filter(rivals, lambda m: m["old"] > e["old"])) == 0
            )

        return F.filter(es, wins)

    return let(
        entries,
        lambda es: F.map_from_entries(
            F.transform(winners(es), lambda e: F.struct(e["key"], F.element_at(node, e["old"])))
        ),
    )


def doc_replace(
    df: DataFrame,
    doc_col: str,
    path: str,
    replace: Callable[[Column], Column],
    where: Callable[[Column], Column] | None = None,
    keys: bool = False,
) -> DataFrame:
    """Replace the string values found at `path`, or rename the keys of the maps found there.

    Adds `replaced`, the number of leaves changed per document. Text that cannot be read is left as it is.
    """
    test = where or (lambda _: F.lit(True))
    kind = df.schema[doc_col].dataType
    if isinstance(kind, (T.StringType, T.VariantType)):
        names = df.columns
        df = df.withColumn("_text", _text_of(df, doc_col)).withColumn("_walked", _walk_column(df, doc_col))
        wanted = "key" if keys else "string"

        def hit(x: Column) -> Column:
            return (x["kind"] == wanted) & (x["path"] == path) & F.coalesce(test(x["value"]), F.lit(False))

        leaves = F.col("_walked.leaves")
        new = F.transform(leaves, lambda x: F.when(hit(x), replace(x["value"])).otherwise(x["value"]))
        put = filled(F.col("_text"), F.col("_new"), scalars=isinstance(kind, T.VariantType))
        back = put if isinstance(kind, T.StringType) else F.parse_json(put)
        count = F.when(F.col("_walked.state") == "json", F.size(F.filter(leaves, hit))).otherwise(0)
        df = df.withColumns({"replaced": count.cast("bigint"), "_new": new})
        out = F.when(F.col("_walked.state") == "json", back).otherwise(F.col(doc_col))
        return df.withColumn(doc_col, out).select(*[F.col(f"`{n}`") for n in names], "replaced")

    def below_map(node: Column, k: T.DataType, at: Column) -> tuple[Column, Column]:
        """The same where the path depends on the row."""
        zero = F.lit(0)
        if isinstance(k, T.StringType):
            match = F.coalesce((at == path) & test(node), F.lit(False)) & node.isNotNull() & F.lit(not keys)
            return F.when(match, replace(node)).otherwise(node), match.cast("int")
        if isinstance(k, T.StructType):
            made = [(f.name, *below_map(node.getField(f.name), f.dataType, _join(at, F.lit(f.name)))) for f in k.fields]
            value = F.struct(*[v.alias(name) for name, v, _ in made])
            return F.when(node.isNull(), node).otherwise(value), F.coalesce(sum((n for _, _, n in made), zero), zero)
        if isinstance(k, T.ArrayType):
            inner = F.concat(at, F.lit("[]"))
            counts = F.transform(node, lambda x: below_map(x, k.elementType, inner)[1])
            return F.transform(node, lambda x: below_map(x, k.elementType, inner)[0]), F.coalesce(F.aggregate(counts, zero, lambda a, n: a + n), zero)
        if isinstance(k, T.MapType):
            step = lambda name, v: below_map(v, k.valueType, _join(at, name))
            value = F.transform_values(node, lambda name, v: step(name, v)[0])
            counts = F.transform(F.map_entries(node), lambda e: step(e["key"], e["value"])[1])
            n = F.coalesce(F.aggregate(counts, zero, lambda a, n: a + n), zero)
            if not keys:
                return value, n
            own = F.when(at == path, F.size(F.filter(F.map_keys(node), lambda x: F.coalesce(test(x), F.lit(False))))).otherwise(0)
            return F.when(at == path, _rename_keys(value, test, replace)).otherwise(value), F.when(node.isNull(), 0).otherwise(n + own)
        return node, zero

    def change(node: Column, k: T.DataType, at: str) -> tuple[Column, Column]:
        """(new node, number of changes below it)."""
        zero = F.lit(0)
        if isinstance(k, T.StringType):
            if keys or at != path:
                return node, zero
            match = F.coalesce(test(node), F.lit(False)) & node.isNotNull()
            return F.when(match, replace(node)).otherwise(node), match.cast("int")
        if isinstance(k, T.StructType):
            fields, counts = [], []
            for f in k.fields:
                value, n = change(node.getField(f.name), f.dataType, f"{at}.{f.name}" if at else f.name)
                fields.append(value.alias(f.name))
                counts.append(n)
            total = sum(counts[1:], counts[0]) if counts else zero
            return F.when(node.isNull(), node).otherwise(F.struct(*fields)), F.coalesce(total, zero)
        if isinstance(k, T.ArrayType):
            inner = f"{at}[]"
            if not (path == inner or path.startswith((inner + ".", inner + "[]"))):
                return node, zero
            value = F.transform(node, lambda x: change(x, k.elementType, inner)[0])
            counts = F.transform(node, lambda x: change(x, k.elementType, inner)[1])
            return value, F.coalesce(F.aggregate(counts, F.lit(0), lambda a, n: a + n), zero)
        if isinstance(k, T.MapType):
            if keys and at == path:
                n = F.size(F.filter(F.map_keys(node), lambda x: F.coalesce(test(x), F.lit(False))))
                return _rename_keys(node, test, replace), F.when(node.isNull(), 0).otherwise(n)
            if not isinstance(k.valueType, T.StringType):
                below = lambda name, v: below_map(v, k.valueType, _join(F.lit(at), name))
                value = F.transform_values(node, lambda name, v: below(name, v)[0])
                counts = F.transform(F.map_entries(node), lambda e: below(e["key"], e["value"])[1])
                return value, F.coalesce(F.aggregate(counts, zero, lambda a, n: a + n), zero)
            if keys:
                return node, zero
            here = lambda name, v: (_join(F.lit(at), name) == path) & F.coalesce(test(v), F.lit(False))
            value = F.transform_values(node, lambda name, v: F.when(here(name, v), replace(v)).otherwise(v))
            n = F.size(F.map_filter(node, here))
            return value, F.when(node.isNull(), 0).otherwise(n)
        return node, zero

    value, count = change(F.col(doc_col), kind, "")
    return df.withColumns({"replaced": count.cast("bigint"), doc_col: value})


def secret_manifest_mask(df: DataFrame, json_col: str) -> DataFrame:
    """Hide `data` and `stringData` of Secret manifests in JSON or YAML, at any depth of lists.

    Other text is left as it is. A manifest that cannot be read and may hold a secret is hidden as a whole.
    """
    return cols.replace_columns(df, {json_col: secrets_hidden(F.col(json_col))})
