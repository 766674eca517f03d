"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_str, _int, _long = T.StringType(), T.IntegerType(), T.LongType()

SEQ = _schema(path=_str, pos=_int)

FILES = _schema(repo=_str, artifact=_str, path=_str, rel_path=_str, file_name=_str, length=_long,
                content=T.BinaryType())
CODE_TYPES = _schema(code_type=_str, display=_str, side=_str, suffix=_str)
FUNCTIONS = _schema(artifact=_str, code_type=_str, side=_str, path=_str, pos=_int, name=_str, text=_str,
                    head=_str, body=_str, tail=_str, function_id=_str)
EXAMPLES = _schema(artifact=_str, code_type=_str, ident=_str, source=_str, decompiled=_str, seq=SEQ)
REJECTS = _schema(artifact=_str, path=_str, pos=_int, reason=_str, detail=_str)
SEGMENTS = _schema(rel_path=_str, pos=_int, kind=T.ByteType(), text=_str)
ENCODINGS = _schema(ident=_str, input_ids=T.ArrayType(_int), attention_mask=T.ArrayType(_int),
                    labels=T.ArrayType(_int))
PREDICTIONS = _schema(ident=_str, pos=_int, pred_id=_int, label_id=_int)
PACKAGES = _schema(repo=_str, line_no=_long, package=_str, version=_str)
LEDGER = _schema(repo=_str, package=_str, status=_str, ts=T.TimestampType())
INCLUDES = _schema(path=_str, pos=_int, target=_str, is_system=T.BooleanType(), resolved_path=_str)
