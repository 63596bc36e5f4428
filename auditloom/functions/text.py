"""Text expressions: tokens, names, roles, kinds, verbs. Everything stays a JVM-side column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[key]


def first_match(cases: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(cond, value) for cond, value in cases])


# ---- tokens -------------------------------------------------------------------------------------
def property_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({V.PROPERTY_TOKEN})"), 1)


def word_tokens(text: Column) -> Column:
    """Lowercase alphanumeric words; the dotted capital I is an i, not an i and a separate dot."""
    lowered = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))
    return F.filter(F.split(lowered, "[^a-z0-9]+"), lambda t: t != "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, for array expressions used several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_bigrams(tokens: Column, cap: int = 256) -> Column:
    """Tokens followed by the joined neighbours, first ``cap`` entries (the cap is the feature)."""

    def extend(t: Column) -> Column:
        heads = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
        tails = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
        return F.slice(F.concat(t, F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit("_"), b))), 1, cap)

    return bind(tokens, extend)


def thinned_tokens(tokens: Column, key: Column, seed: int, drop: float, never_empty: bool = True) -> Column:
    """Drop tokens by a hash draw on (key, position); a fully dropped list keeps everything if it is to be ``never_empty``."""
    from auditloom.functions.hashing import unit_draw

    def thin(t: Column) -> Column:
        kept = F.filter(t, lambda x, i: unit_draw(key, i, seed) >= drop)
        if not never_empty:
            return kept
        return bind(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(t))

    return bind(tokens, thin)


def redact_events(text: Column, word: str = "REDACTED") -> Column:
    return F.regexp_replace(text, r"(?<!\w)EVENT\S*", word)


def clean_description(text: Column) -> Column:
    """Remove citations and code tags, keep the text of markdown links."""
    text = F.trim(F.regexp_replace(text, r"\(Citation:[^)]*\)", ""))
    text = F.regexp_replace(text, r"</?code>", "")
    return F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")


def parent_technique(tech_id: Column) -> Column:
    return F.substring_index(tech_id, ".", 1)


# ---- names, roles, kinds ------------------------------------------------------------------------
def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def process_name(props: Column) -> Column:
    """Process name from 'cmdLine,tgid,path', from a path, or the text itself."""
    parts = F.split(props, ",")
    from_path = basename(F.trim(F.get(parts, F.lit(2))))
    other = F.when(props.contains("/"), basename(props)).otherwise(F.trim(props))
    return F.when(props.isNull() | (props == ""), "").when(F.size(parts) >= 3, from_path).otherwise(other)


def quoted_name(props: Column) -> Column:
    """Process name from a dict-like text, or the text itself when it is short and not a dict."""
    text = F.trim(props)
    single = F.regexp_extract(text, r"'name'\s*:\s*'([^']+)'", 1)
    double = F.regexp_extract(text, r'"name"\s*:\s*"([^"]+)"', 1)
    short = F.when((text != "") & ~text.startswith("{") & (F.length(text) < 50), text).otherwise("")
    return F.when(single != "", single).when(double != "", double).otherwise(short)


def process_role(name: Column) -> Column:
    base = basename(F.lower(F.trim(name)))
    return F.coalesce(lookup(V.PROCESS_ROLES, base), base)


def is_known_process(name: Column) -> Column:
    return lookup(V.PROCESS_ROLES, basename(F.lower(F.trim(name)))).isNotNull()


def file_kind(path: Column) -> Column:
    """Kind by extension, else by the first path marker, else ''."""
    text = F.trim(path)
    by_extension = F.when(
        text.contains("."),
        lookup(V.FILE_EXTENSIONS, F.concat(F.lit("."), F.substring_index(text, ".", -1))),
    )
    by_marker = first_match([(text.contains(m), F.lit(kind)) for m, kind in V.PATH_MARKERS])
    return F.coalesce(by_extension, by_marker, F.lit(""))


def port_class(port: Column) -> Column:
    return F.coalesce(lookup(V.PORT_CLASSES, F.trim(port)), F.lit(""))


def is_private_ip(ip: Column) -> Column:
    """RFC 1918 and loopback by address arithmetic."""
    text = F.trim(ip)
    octet = [F.get(F.split(text, r"\."), F.lit(i)).try_cast("int") for i in range(4)]
    valid = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (
        (octet[0] == 10)
        | (octet[0] == 127)
        | ((octet[0] == 192) & (octet[1] == 168))
        | ((octet[0] == 172) & octet[1].between(16, 31))
    )
    return F.coalesce((valid & inside) | (text == "localhost"), F.lit(False))


def type_noun(node_type: Column) -> Column:
    return F.coalesce(lookup(V.TYPE_NOUNS, node_type), node_type)


# ---- events in words ----------------------------------------------------------------------------
def event_verb(action: Column) -> Column:
    return lookup(V.EVENT_VERBS, action)


def low_information(phrase: Column) -> Column:
    from auditloom.functions.hashing import any_of

    return any_of([phrase.startswith(v) for v in V.LOW_INFORMATION_VERBS])


def event_phrase(event: Column) -> Column:
    """'EVENT_WRITE /tmp/a.so' -> 'writes /tmp/a.so shared library'; '' for unknown events."""
    text = F.trim(event)
    verb = event_verb(F.regexp_extract(text, r"^(\S+)", 1))
    target = F.regexp_extract(text, r"^\S+\s+([\s\S]*)$", 1)
    kind = file_kind(target)
    full = F.concat_ws(" ", verb, target, F.when(kind != "", kind))
    return (
        F.when(verb.isNull(), "").when(verb.contains(" ") | (target == ""), verb).otherwise(full)
    )


# ---- technique descriptions in words ----------------------------------------------------------------
def intent_subject(text: Column) -> Column:
    return F.coalesce(lookup(V.INTENT_SUBJECTS, F.lower(F.trim(text))), F.lit("process"))


def intent_operations(verb: Column) -> Column:
    """Array of operations for an intent verb, null when the verb is not covered."""
    word = F.lower(F.trim(verb))
    ops = {k: F.array(*[F.lit(x) for x in v]) for k, v in V.INTENT_VERBS.items()}
    exact = first_match([(word == k, v) for k, v in ops.items()])
    stem = first_match([(word.startswith(k) | F.lit(k).startswith(word), v) for k, v in ops.items()])
    return F.coalesce(exact, stem)


def intent_object(text: Column) -> Column:
    word = F.lower(F.trim(text))
    for modifier in V.INTENT_MODIFIERS:
        word = F.trim(F.replace(word, F.lit(modifier), F.lit("")))
    part = first_match([(word.contains(k), F.lit(v)) for k, v in V.INTENT_OBJECTS.items()])
    return F.coalesce(lookup(V.INTENT_OBJECTS, word), part, word)


# ---- property layouts ---------------------------------------------------------------------------
def process_fields(props: Column) -> list[Column]:
    """(command line, thread group, path) of 'cmdLine,tgid,path'; the path keeps further commas."""
    parts = F.split(props, ",", 3)
    return [F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))) for i in range(3)]


def network_fields(props: Column) -> list[Column]:
    parts = F.split(props, ",")
    return [F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))) for i in range(4)]


def edge_category(actions: Column) -> Column:
    """Category of the first known action of an array, else the default."""
    categories = V.EDGE_CATEGORIES
    known = F.filter(F.transform(actions, lambda a: lookup(categories, F.trim(a))), lambda c: c.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(V.DEFAULT_EDGE_CATEGORY))


def is_process(node_type: Column) -> Column:
    t = F.lower(node_type)
    return t.contains("process") | t.contains("subject")


def is_file(node_type: Column) -> Column:
    return ~is_process(node_type) & F.lower(node_type).contains("file")


def is_network(node_type: Column) -> Column:
    t = F.lower(node_type)
    return ~is_process(node_type) & ~is_file(node_type) & (t.contains("net") | t.contains("flow") | t.contains("sock"))
