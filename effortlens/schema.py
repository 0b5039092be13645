"""Declared schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per file touched by a commit.
MOD = _struct(
    ("hash", _S),
    ("Author", _S),
    ("Email", _S),
    ("message", _S),
    ("authored_date", _S),
    ("Committer", _S),
    ("committed_date", _S),
    ("number_of_branches", _I),
    ("in_main_branch", _B),
    ("merge_commit", _B),
    ("number_of_mod_files", _I),
    ("file_name", _S),
    ("file_ext", _S),
    ("file_change_type_name", _S),
    ("file_change_type_value", _I),
    ("file_old_path", _S),
    ("file_new_path", _S),
    ("number_functions_before", _I),
    ("number_functions_after", _I),
    ("number_functions_edited", _I),
    ("number_lines_added", _I),
    ("number_lines_removed", _I),
    ("file_number_loc", _I),
    ("language_supported", _B),
    ("file_size", _I),
    ("dmm_unit_size", _D),
    ("dmm_unit_complexity", _D),
    ("dmm_unit_interfacing", _D),
    ("file_complexity", _I),
    ("tokens", _I),
)

# At the file edge this column carries a question mark.
EDGE_NAMES = {"merge_commit": "merge_commit?"}

_LINES = T.ArrayType(_struct(("line_no", _I), ("text", _S)))

MODIFICATION = _struct(
    ("filename", _S),
    ("change_type", _struct(("name", _S), ("value", _I))),
    ("old_path", _S),
    ("new_path", _S),
    ("methods_before", T.ArrayType(_S)),
    ("methods", T.ArrayType(_S)),
    ("changed_methods", T.ArrayType(_S)),
    ("added", _I),
    ("removed", _I),
    ("nloc", _I),
    ("language_supported", _B),
    ("source_code", _S),
    ("complexity", _I),
    ("token_count", _I),
    ("diff_added", _LINES),
    ("diff_deleted", _LINES),
)

# One row per commit, its file modifications nested.
COMMIT = _struct(
    ("hash", _S),
    ("author", _struct(("name", _S), ("email", _S))),
    ("committer", _struct(("name", _S))),
    ("msg", _S),
    ("author_date", T.TimestampType()),
    ("committer_date", T.TimestampType()),
    ("branches", T.ArrayType(_S)),
    ("in_main_branch", _B),
    ("merge", _B),
    ("dmm_unit_size", _D),
    ("dmm_unit_complexity", _D),
    ("dmm_unit_interfacing", _D),
    ("modifications", T.ArrayType(MODIFICATION)),
)

BLAME = _struct(("orig_hash", _S), ("blame_hash", _S), ("file", _S))

EMAIL_MAP = _struct(("Email_encrypted", _S), ("Email", _S))

# Columns replaced by their hash before data leaves its owner.
PERSONAL = ("Author", "Email", "Committer", "file_name", "file_old_path", "file_new_path")

# The features, in the order every model keeps.
FEATURES = (
    "feature_total_changed",
    "feature_add_del_functions",
    "feature_changed_functions",
    "feature_dmm_unit_complexity",
    "feature_dmm_size",
    "feature_dmm_unit_interfacing",
)

MIXTURE = _struct(
    ("file_ext", _S),
    ("cluster", _I),
    ("weight", _D),
    ("mean", T.ArrayType(_D)),
    ("covariance", T.ArrayType(_D)),
    ("precision_root", T.ArrayType(_D)),
    ("log_det", _D),
)

# What stands for a missing extension and a missing model.
NO_EXT = "NoExt"
NO_MODEL = "No Model found"
