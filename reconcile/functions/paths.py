"""Keys and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .kinds import MANAGED_KINDS
from .text import strip

# Fixed values.
MAX_KEY_UNITS = 512          # UTF-16 units an audit key column can hold
MAX_IDENT_CHARS = 128
TRANSITION_FILE = r"(?is)^(\d{3})_([0-9a-f]{7,})_(.+)\.sql$"
# First line of a generated, not yet authored transition script.  The text is
# a convention of the tool that writes the scripts, so callers may pass theirs.
SCAFFOLD_MARK = "-- transition-scaffold"


def normalized_key(schema: Column, kind: Column, name: Column) -> Column:
    sep = F.lit("/")
    return F.lower(F.concat(schema, sep, kind, sep, name))


def _part(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i))


def key_from_path(path: Column) -> Column:
    """Key from the last three components; NULL with fewer than four."""
    parts = F.split(F.regexp_replace(path, r"(\.sql)+$", ""), "/")
    key = normalized_key(_part(parts, -3), _part(parts, -2), _part(parts, -1))
    return F.when(F.size(parts) >= 4, key)


def split_key(key: Column) -> Column:
    p = F.split(key, "/", 3)
    return F.struct(
        _part(p, 1).alias("schema_name"),
        _part(p, 2).alias("kind"),
        _part(p, 3).alias("object_name"),
    )


def snapshot_key(database: Column, key: Column) -> Column:
    """Database-qualified identity used by snapshots and deltas."""
    return F.when(F.coalesce(database, F.lit("")) == "", key).otherwise(
        F.concat(database, F.lit("/"), key)
    )


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def _after(path: Column, n: Column) -> Column:
    return F.substring(path, n + F.lit(1), F.lit(2147483647))


def normalize_path(path: Column, prefix: str = "sql/") -> Column:
    """Forward slashes, repository prefix removed, blank becomes NULL."""
    p = forward_slashes(strip(path))
    cut = F.when(p.startswith(prefix), _after(p, F.lit(len(prefix)))).when(
        p.startswith("sql/"), _after(p, F.lit(4))
    ).otherwise(p)
    return F.nullif(cut, F.lit(""))


def parse_changed_csv(csv: Column) -> Column:
    """Comma list of changed files as an array without blanks."""
    items = F.transform(F.split(csv, ","), lambda s: forward_slashes(strip(s)))
    return F.filter(items, lambda s: s != "")


def with_database_prefix(database: Column, path: Column) -> Column:
    p = forward_slashes(path)
    head = F.concat(database, F.lit("/"))
    return (
        F.when(database == "", p)
        .when(p.startswith(head), p)
        .otherwise(F.concat(head, F.ltrim(p, F.lit("/"))))
    )


def path_candidates(database: Column, path: Column) -> Column:
    """Lookup spellings: as given, with and without the database folder."""
    head = F.concat(database, F.lit("/"))
    bare = F.when(path.startswith(head), _after(path, F.length(head)))
    out = F.array_distinct(F.array(path, with_database_prefix(database, path), bare))
    return F.when(database == "", F.array(path)).otherwise(
        F.filter(out, lambda s: s.isNotNull())
    )


def strip_sql_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.sql$", "")


def parse_transition(path: Column) -> Column:
    """Parts of an authored change script path, or NULL when it is not one."""
    parts = F.split(path, "/")
    file = _part(parts, -1)
    schema, table = _part(parts, -5), _part(parts, -2)
    ok = (
        (F.size(parts) >= 6)
        & (_part(parts, -4) == "tables")
        & (_part(parts, -3) == "_migrations")
        & file.rlike(TRANSITION_FILE)
    )
    return F.when(
        ok,
        F.struct(
            _part(parts, 1).alias("database_name"),
            normalized_key(schema, F.lit("tables"), table).alias("normalized_key"),
            F.regexp_extract(file, TRANSITION_FILE, 1).alias("ordinal"),
            F.regexp_extract(file, TRANSITION_FILE, 2).alias("commit"),
            F.regexp_extract(file, TRANSITION_FILE, 3).alias("slug"),
        ),
    )


def is_scaffold(text: Column, marker: str = SCAFFOLD_MARK) -> Column:
    return F.substring_index(text, "\n", 1).startswith(marker)


def is_check_path(path: Column) -> Column:
    parts = F.split(path, "/")
    n = F.size(parts)
    return (
        ((n == 3) | (n == 4)) & (_part(parts, -2) == "checks") & (_part(parts, -1) != "")
    )


def classify_path(path: Column) -> Column:
    """``transition``, ``check``, ``object`` or ``ignored``, by position only."""
    parts = F.split(path, "/")
    managed = (F.size(parts) == 4) & _part(parts, -2).isin(MANAGED_KINDS)
    return (
        F.when(
            F.contains(path, F.lit("/tables/_migrations/")),
            F.when(parse_transition(path).isNotNull(), "transition").otherwise("ignored"),
        )
        .when(is_check_path(path), "check")
        .when(managed, "object")
        .otherwise("ignored")
    )


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def valid_component(name: Column) -> Column:
    """A single path level: not blank, not a dot name, no separator or NUL."""
    return F.coalesce(
        (name != "") & ~name.isin(".", "..") & ~name.rlike("[/\\\\\\x00]"), F.lit(False)
    )


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))


def valid_ident(name: Column) -> Column:
    return valid_component(name) & (F.char_length(name) <= MAX_IDENT_CHARS)


def bracket_ident(name: Column) -> Column:
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))
