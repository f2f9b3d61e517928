"""Column functions over paths, qualified names and graph keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the extensions that a symbol's file loses in its dotted name.
EXTENSIONS = ("tsx", "ts", "jsx", "js", "mjs", "cjs")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dir_of(path: Column | str) -> Column:
    """Text before the last slash; null if there is none or only a leading one."""
    path = _col(path)
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut))


def cap_depth(directory: Column | str, depth: int | None) -> Column:
    directory = _col(directory)
    return directory if depth is None else F.substring_index(directory, "/", depth)


def name_file(qualified_name: Column | str) -> Column:
    """The file in a qualified name; null without ``::``."""
    qn = _col(qualified_name)
    return F.when(F.instr(qn, "::") > 0, F.substring_index(qn, "::", 1))


def owner_file(kind: Column | str, qualified_name: Column | str, file_path: Column | str) -> Column:
    """The file that a node belongs to: a file's own path, else that of its name, else its path."""
    own, kind = F.nullif(_col(file_path), F.lit("")), _col(kind)
    return F.when((kind == "file") & own.isNotNull(), own).otherwise(F.coalesce(F.nullif(name_file(qualified_name), F.lit("")), own))


def base_name(path: Column | str) -> Column:
    return F.coalesce(F.nullif(F.substring_index(_col(path), "/", -1), F.lit("")), _col(path))


def group_id(path: Column | str) -> Column:
    return F.concat(F.lit("group:path:"), _col(path))


def territory_id(decision: Column | str) -> Column:
    return F.concat(F.lit("group:decision:"), _col(decision))


def edge_key(source: Column | str, target: Column | str, relation: Column | str) -> Column:
    return F.concat(_col(source), F.lit("→"), _col(target), F.lit(":"), _col(relation))


def ancestors(path: Column | str, strict: bool = False) -> Column:
    """The path and every directory above it with a level, from 0 for the path itself."""
    path = _col(path)
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1 if strict else 0), F.greatest(F.size(parts) - 1, F.lit(1 if strict else 0))), lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("path")))
    return F.filter(up, lambda a: a.path != "")


def normalize_name(symbol: Column | str, project: Column | str) -> Column:
    """``dir/file.ts::sym`` as ``project.dir.file.sym``; anything else as it is; an empty name fails."""
    symbol, project = _col(symbol), _col(project)
    file = F.regexp_replace(F.substring_index(symbol, "::", 1), rf"\.({'|'.join(EXTENSIONS)})$", "")
    name = F.split(symbol, "::")[1]
    dotted = F.concat(project, F.lit("."), F.replace(file, F.lit("/"), F.lit(".")), F.lit("."), name)
    bad = F.raise_error(F.lit("a qualified name and its project must not be empty")).cast("string")
    return F.when(symbol == "", bad).when(F.instr(symbol, "::") == 0, symbol).when(F.coalesce(project, F.lit("")) == "", bad).otherwise(dotted)


def denormalize_name(qualified_name: Column | str, file_path: Column | str) -> Column:
    """``file::sym`` if the dotted file stands in the name, else the name."""
    qn, file = _col(qualified_name), _col(file_path)
    dotted = F.concat(F.lit("."), F.replace(F.regexp_replace(file, rf"\.({'|'.join(EXTENSIONS)})$", ""), F.lit("/"), F.lit(".")), F.lit("."))
    at = F.instr(qn, dotted)
    return F.when((F.coalesce(file, F.lit("")) != "") & (at > 0), F.concat(file, F.lit("::"), F.substring(qn, at + F.length(dotted), F.length(qn)))).otherwise(qn)
