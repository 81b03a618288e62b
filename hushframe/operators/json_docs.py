"""JSON texts as flat lists of leaves and back: the only step of document work that needs a parser.

The functions here walk; every rule is applied in between, by built-in expressions over the list of leaves, so a
plan has the same size for documents of any depth. A repeated key counts with its last value. Numbers keep the text
they were written with.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 100
SECRET = "***redacted***"
LEAF = "struct<path:string,key:string,value:string,kind:string,before:string>"
# states: json; text (does not begin like a document), broken (begins like one), deep (too many levels), null
# once: no object of the document has a key twice
WALKED = f"struct<state:string,once:boolean,leaves:array<{LEAF}>,rest:string>"
OPENINGS = ("{", "[")
BLANKS = " \t\r\n\ufeff"


class Number(str):
    """A number as it was written."""


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


class Repeated(dict):
    """An object in which a key came more than once."""


def _object(pairs: list[tuple[str, Any]]) -> dict:
    node = dict(pairs)
    return node if len(node) == len(pairs) else Repeated(node)


def parse(text: str) -> Any:
    """The document, or ValueError; RecursionError far beyond any allowed depth."""
    node = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_refuse, object_pairs_hook=_object)
    text.encode("utf-8")
    return node


def depth_of(node: Any) -> tuple[int, bool]:
    """Levels of containers, and whether no object repeats a key; found without recursion."""
    top, once, todo = 0, True, [(node, 0)]
    while todo:
        here, level = todo.pop()
        if isinstance(here, (dict, list)):
            top, once = max(top, level + 1), once and not isinstance(here, Repeated)
            todo += [(x, level + 1) for x in (here.values() if isinstance(here, dict) else here) if isinstance(x, (dict, list))]
    return top, once


def _last(path: str) -> str:
    return path.rsplit(".", 1)[-1].removesuffix("[]")


NAMES = ("path", "key", "value", "kind", "before")


class Leaves:
    """Leaves of many documents as flat columns, each document's in its order; `fill` takes new values in the same order.

    `before` is the JSON text between the value before and this one; what is left of it is the document's `rest`.
    `plain` leaves are only keys and strings, without the JSON text around them.
    """

    def __init__(self, plain: bool = False) -> None:
        self.plain = plain
        self.columns: tuple[list[str], ...] = ([], [], [], [], [])
        self.text: list[str] = []
        self.quoted: dict[str, str] = {}

    def _key(self, key: str) -> str:
        if key not in self.quoted:
            if len(self.quoted) > 50_000:  # keys may be data
                self.quoted.clear()
            self.quoted[key] = json.dumps(key, ensure_ascii=False)
        return self.quoted[key]

    def add(self, node: Any, path: str, key: str) -> None:
        text = self.text
        if isinstance(node, dict):
            sign = "{"
            for k in sorted(node):
                self._leaf(path, k, k, "key", "")
                text.append(f"{sign}{self._key(k)}:")
                sign = ","
                self.add(node[k], f"{path}.{k}" if path else k, k.rsplit(".", 1)[-1].removesuffix("[]"))
            text.append("}" if node else "{}")
        elif isinstance(node, list):
            text.append("[")
            inner, key = path + "[]", _last(path + "[]")
            for i, x in enumerate(node):
                if i:
                    text.append(",")
                self.add(x, inner, key)
            text.append("]")
        elif node is None:
            text.append("null")
        else:
            kind = "bool" if isinstance(node, bool) else "number" if isinstance(node, Number) else "string"
            before = "".join(text)
            text.clear()
            self._leaf(path, key, str(node).lower() if kind == "bool" else str(node), kind, before)

    def add_plain(self, node: Any, path: str, key: str) -> None:
        if isinstance(node, dict):
            for k in sorted(node):
                self._leaf(path, k, k, "key", "")
                x = node[k]
                if x is not None and not isinstance(x, (bool, Number)):
                    self.add_plain(x, f"{path}.{k}" if path else k, k.rsplit(".", 1)[-1].removesuffix("[]"))
        elif isinstance(node, list):
            inner, key = path + "[]", _last(path + "[]")
            for x in node:
                self.add_plain(x, inner, key)
        elif isinstance(node, str) and not isinstance(node, Number):
            self._leaf(path, key, node, "string", "")

    def _leaf(self, path: str, key: str, value: str, kind: str, before: str) -> None:
        a, b, c, d, e = self.columns
        a.append(path)
        b.append(key)
        c.append(value)
        d.append(kind)
        e.append(before)

    def document(self, node: Any, prefix: str, escaped: bool = True) -> str | None:
        """Adds a document; its rest, or None (and nothing added) if it holds half a surrogate pair, which only an
        escaped text can."""
        first = len(self.columns[0])
        self.text.clear()
        (self.add_plain if self.plain else self.add)(node, prefix, _last(prefix))
        rest = "".join(self.text)
        if not escaped:
            return rest
        try:
            "".join([rest, *(v for c in self.columns for v in c[first:])]).encode()
        except UnicodeEncodeError:
            for c in self.columns:
                del c[first:]
            return None
        return rest


def fill(node: Any, values: Iterator[str | None]) -> str:
    """The document as JSON text with the leaves' new values; keys that become equal: the last in key order wins,
    a renamed one before one that was there."""
    if isinstance(node, dict):
        plain, renamed = {}, {}
        for k in sorted(node):
            new = next(values)
            text = fill(node[k], values)
            (plain if new == k else renamed)["" if new is None else new] = text
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in sorted((plain | renamed).items())) + "}"
    if isinstance(node, list):
        return "[" + ",".join(fill(x, values) for x in node) + "]"
    if node is None:
        return "null"
    new = next(values)
    if isinstance(node, (bool, Number)):
        return "null" if new is None else new
    return json.dumps(new or "", ensure_ascii=False)


def read(text: str | None, max_depth: int, scalars: bool = False) -> tuple[str, Any, bool]:
    """State and document of a text, and whether no key is repeated. A bare number, word or string is a plain text
    unless `scalars` are documents too."""
    if text is None:
        return "null", None, True
    begins = text.lstrip(BLANKS)[:1] in OPENINGS
    if not begins and not scalars:
        return "text", None, True
    try:
        node = parse(text)
    except RecursionError:
        return "deep", None, True
    except ValueError:
        return ("broken" if begins else "text"), None, True
    depth, once = depth_of(node)
    return ("deep", None, once) if depth - 1 > max_depth else ("json", node, once)


def walked(text: Column, max_depth: int = MAX_DEPTH, prefix: str = "", scalars: bool = False, plain: bool = False) -> Column:
    """State and leaves of each JSON text; paths begin with `prefix`. `plain`: only keys and strings, not to be rebuilt."""

    @F.arrow_udf(WALKED)
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found, states, onces, rests, ends = Leaves(plain), [], [], [], [0]
            for x in column.to_pylist():
                state, node, once = read(x, max_depth, scalars)
                rest = found.document(node, prefix, "\\u" in x) if state == "json" else ""
                if rest is None:  # half a surrogate pair cannot be stored as text
                    state, rest = "broken", ""
                states.append(state)
                onces.append(once)
                rests.append(rest)
                ends.append(len(found.columns[0]))
            leaves = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in found.columns], NAMES)
            parts = [pa.array(states), pa.array(onces), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaves), pa.array(rests, pa.string())]
            yield pa.StructArray.from_arrays(parts, ("state", "once", "leaves", "rest"))

    return walk(text)


def rebuilt(found: Column, values: Column) -> Column:
    """The JSON text of a walk with new values of its leaves; keys stay."""

    def shown(leaf: Column, new: Column) -> Column:
        quoted = F.to_json(F.array(F.coalesce(new, F.lit(""))))
        text = F.when(leaf["kind"] == "string", F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)).when(leaf["kind"] != "key", new)
        return F.concat(leaf["before"], F.coalesce(text, F.lit("")))

    return F.concat(F.array_join(F.zip_with(found["leaves"], values, shown), ""), found["rest"])


def filled(text: Column, values: Column, max_depth: int = MAX_DEPTH, scalars: bool = False) -> Column:
    """Each JSON text with new values of its leaves, in the order of `walked`; null where that found no document."""

    @F.arrow_udf("string")
    def put(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, news in batches:
            out = []
            for x, new in zip(texts.to_pylist(), news.to_pylist()):
                state, node, _ = read(x, max_depth, scalars)
                out.append(fill(node, iter(new)) if state == "json" and new is not None else None)
            yield pa.array(out, pa.string())

    return put(text, values)


def _hide(node: Any) -> Any:
    """Secrets in an object, a list, or the items of a list object."""
    if isinstance(node, list):
        return [_hide(x) for x in node]
    if not isinstance(node, dict):
        return node
    kind = node.get("kind")
    secret = isinstance(kind, str) and not isinstance(kind, Number) and kind.lower() == "secret"
    out = {}
    for k, v in node.items():
        if k == "items" and isinstance(v, list):
            out[k] = _hide(v)
        elif secret and k in ("data", "stringData") and isinstance(v, dict):
            out[k] = {name: SECRET for name in v}
        else:
            out[k] = v
    return out


def _dump(node: Any) -> str:
    """JSON text of a parsed document, numbers as they were written."""
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(_dump, node)) + "]"
    return str(node) if isinstance(node, Number) else json.dumps(node, ensure_ascii=False)


def _yaml_loader():
    """Safe loaders that refuse repeated keys, the compiled one first where there is one; None without the package."""
    try:
        import yaml
    except ImportError:
        return None

    class Unrepeated:
        def construct_mapping(self, node, deep=False):
            keys = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode) and k.tag != "tag:yaml.org,2002:merge"]
            if len(keys) > len(set(keys)):
                raise yaml.constructor.ConstructorError(None, None, "repeated key", node.start_mark)
            return super().construct_mapping(node, deep)

    compiled = (yaml.CSafeLoader,) if yaml.__with_libyaml__ else ()
    return [type("Loader", (Unrepeated, base), {}) for base in (*compiled, yaml.SafeLoader)]


def _hide_yaml(text: str, loaders: list[type] | None) -> str | None:
    """A YAML stream with its secrets hidden; None when it cannot be read. Texts without secrets stay as they are."""
    if loaders is None:
        return None
    import yaml

    # only plain characters: the compiled reader and writer treat some others differently
    plain = text.isascii() and text.replace("\n", "").isprintable()
    for loader in loaders if plain else loaders[-1:]:
        try:
            parts = list(yaml.load_all(text, loader))
            hidden = [_hide(p) for p in parts]
            dumper = yaml.SafeDumper if loader is loaders[-1] else yaml.CSafeDumper
            return text if hidden == parts else yaml.dump_all(hidden, None, dumper, sort_keys=False, allow_unicode=True)
        except (yaml.scanner.ScannerError, yaml.parser.ParserError):
            continue  # the other loader may read it
        except (yaml.YAMLError, RecursionError, ValueError, TypeError, AttributeError):
            return None
    return None


# Ways to spell a word with other signs in quotes.
ESCAPES = re.compile(r"\\(?:[xuU]|\r?\n)")


def hide_secrets(text: str | None, loader: list[type] | None) -> str | None:
    """The manifest with the data of its secrets hidden. What may hold a secret and cannot be read is hidden whole."""
    if text is None:
        return text
    low = text.lower()
    escaped = ESCAPES.search(text) is not None
    if "secret" not in low and not escaped:
        return text
    begins = text.lstrip(BLANKS)[:1] in OPENINGS
    if begins:
        try:
            node = parse(text)
            hidden = _hide(node)
            # A repeated key may have hidden a first value: what is shown is what was read.
            out = text if hidden == node and depth_of(node)[1] else _dump(hidden)
            out.encode("utf-8")
            return out
        except (ValueError, RecursionError):
            pass  # flow style of YAML begins like this too
    shown = _hide_yaml(text, loader)
    if shown is not None:
        return shown
    return SECRET if begins or "data" in low else text


def secrets_hidden(text: Column) -> Column:
    @F.arrow_udf("string")
    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loader = _yaml_loader()
        for column in batches:
            yield pa.array([hide_secrets(x, loader) for x in column.to_pylist()], pa.string())

    return hide(text)
