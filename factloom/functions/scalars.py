"""Scalar vocabulary of facts and findings as Column expressions: names, paths, types, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from least to most severe, and their SARIF levels.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SARIF_LEVELS = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}
#: Scope bits of state effects.
REQUEST, SESSION, SERVER = 1, 2, 4


def short_name(fqn: Column) -> Column:
    """Last dotted segment."""
    return F.substring_index(fqn, ".", -1)


def owner_of(fqn: Column) -> Column:
    """All but the last dotted segment; null where there is none."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"\.[^.]*$", ""))


def dotted_prefixes(fqn: Column) -> Column:
    """The name's prefixes on dot boundaries, shortest first, itself included."""
    parts = F.split(fqn, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def dotted_suffixes(fqn: Column) -> Column:
    """The name's suffixes on dot boundaries, longest first, itself included."""
    parts = F.split(fqn, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def short_location(file: Column, line: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"))


def short_expression(expression: Column, limit: int = 48) -> Column:
    """White space collapsed, cut to ``limit`` with three dots as its end."""
    text = F.trim(F.regexp_replace(expression, r"\s+", " "))
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def json_leaf(path: Column) -> Column:
    """Correlation key of a JSON path: its last segment."""
    return F.regexp_replace(F.element_at(F.split(path, r"[.\[]"), -1), r"[\]'\"$]", "")


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by NUL; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def rule_key(rule_id: Column) -> Column:
    """Rule ids compare in lower case, with underscores."""
    return F.lower(F.replace(rule_id, F.lit("-"), F.lit("_")))


def severity_rank(label: Column) -> Column:
    """Place on the severity ladder, from 0; -1 for an unknown label."""
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.lower(label)).cast("int") - 1


def sarif_level(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SARIF_LEVELS.items() for x in kv))[F.lower(label)]


def types_agree(left: Column, right: Column) -> Column:
    """Equal, or one is a dotted suffix of the other."""
    return (left == right) | F.endswith(left, F.concat(F.lit("."), right)) | F.endswith(right, F.concat(F.lit("."), left))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern (``*``, ``?``, ``[...]``), case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c))
        i += 1
    return f"(?s)^{''.join(out)}$"


#: Containers whose values a client can swap for one another, and those that carry a credential.
SUBSTITUTABLE = ("query", "form", "json", "cookie", "header")
CREDENTIALS = ("authorization", "token", "session", "api_key")


def logical_input(container: Column, key: Column, equivalence: str = "exact") -> Column:
    """Identity of a read, ``family:key``; null where the key is unknown.

    ``exact``: the container itself; ``container``: containers that a client can swap count as one; ``credential``: keys
    that carry a credential count as one, wherever they come from.
    """
    family = F.when(container.isin(*SUBSTITUTABLE), "forgeable").otherwise(container)
    if equivalence == "exact":
        return F.concat(container, F.lit(":"), key)
    if equivalence == "container":
        return F.concat(family, F.lit(":"), key)
    if equivalence == "credential":
        return F.when(F.lower(key).isin(*CREDENTIALS), "credential").otherwise(F.concat(family, F.lit(":"), key))
    raise ValueError(f"{equivalence} is no equivalence")


def call_name(expression: Column) -> Column:
    """Short name of what a call's text calls."""
    return F.substring_index(F.substring_index(expression, "(", 1), ".", -1)


def severity_label(rank: Column) -> Column:
    """The ladder's label at a place; null off the ladder."""
    return F.get(F.array(*(F.lit(s) for s in SEVERITIES)), rank)


def parsed_severity(label: Column) -> Column:
    """Place of a label on the ladder; an unknown label fails the query."""
    return F.when(severity_rank(label) >= 0, severity_rank(label)).otherwise(F.raise_error(F.concat(F.coalesce(label, F.lit("null")), F.lit(" is no severity"))).cast("int"))


def stable_key(rule_id: Column, line_text: Column) -> Column:
    """Identity of a finding's place that survives moved lines: of the rule and the stripped source line, 16 hex digits."""
    return F.substring(F.sha2(F.concat(rule_key(rule_id), F.lit("\0"), F.trim(line_text)), 256), 1, 16)


def starts_not_after(left: str, right: str) -> Column:
    """Source order of two spans' starts (structs with ``line`` and ``column``)."""
    at = lambda s: F.struct(F.col(f"{s}.line"), F.col(f"{s}.column"))
    return at(left) <= at(right)


def find_argument(arguments: Column, position: int | None, keyword: str | None) -> Column:
    """The argument of that keyword, else of that position; null without either."""
    by = lambda test: F.get(F.filter(arguments, test), F.lit(0))
    named = by(lambda a: a["keyword"] == keyword) if keyword is not None else None
    placed = by(lambda a: a["keyword"].isNull() & (a["position"] == position)) if position is not None else None
    found = [c for c in (named, placed) if c is not None]
    return F.coalesce(*found)


def receiver_and_method(fqn: Column) -> Column:
    """``receiver`` (null without a dot) and ``method`` of a qualified name."""
    return F.struct(owner_of(fqn).alias("receiver"), short_name(fqn).alias("method"))


def simple_name(expression: Column) -> Column:
    """A bare identifier; null for any other expression."""
    return F.when(expression.rlike(r"^[A-Za-z_]\w*$"), expression)


def type_allows_none(declared: Column) -> Column:
    """Whether a type's text names None or Optional as a word of its own."""
    return declared.rlike(r"(^|[^A-Za-z0-9_])(None|Optional)([^A-Za-z0-9_]|$)")


#: Kinds of type disagreement, and why each of them matters.
RELEVANCE = {
    "optionality": "a check may be skipped where a value is None",
    "container": "a container of another shape may pass a check on its elements",
    "scalar": "a comparison may behave otherwise for another scalar type",
    "callable": "a call may reach another target",
    "identity": "another object may stand in for the checked one",
}


def security_relevance(kind: Column) -> Column:
    """Why a disagreement matters; null where it doesn't."""
    return F.create_map(*(F.lit(x) for kv in RELEVANCE.items() for x in kv))[F.lower(kind)]


def source_fingerprint(path: Column, modified: Column, size: Column) -> Column:
    """Changes when a file's path, time or size does."""
    return fingerprint(path, modified.cast("string"), size.cast("string"))


def path_parameters(rule: Column) -> Column:
    """``array<struct<name,type>>`` of a URL rule, in ``<type:name>`` or ``{name:type}`` form; type ``string`` where none is given."""
    angle = F.transform(F.regexp_extract_all(rule, F.lit(r"<([^<>]+)>"), F.lit(1)), lambda p: F.struct(F.substring_index(p, ":", -1).alias("name"), F.when(F.instr(p, ":") > 0, F.regexp_replace(F.substring_index(p, ":", 1), r"\(.*$", "")).otherwise("string").alias("type")))
    curly = F.transform(F.regexp_extract_all(rule, F.lit(r"\{([^{}]+)\}"), F.lit(1)), lambda p: F.struct(F.substring_index(p, ":", 1).alias("name"), F.when(F.instr(p, ":") > 0, F.substring_index(p, ":", -1)).otherwise("string").alias("type")))
    return F.concat(angle, curly)
