"""Explicit schemas; nothing is inferred at read time."""

from pyspark.sql import types as T

_s = lambda *names: [T.StructField(n, T.StringType()) for n in names]

NOTE_EVENTS = T.StructType([T.StructField("ROW_ID", T.LongType()), T.StructField("SUBJECT_ID", T.LongType()), *_s("HADM_ID", "CHARTDATE", "CHARTTIME", "STORETIME", "CATEGORY", "DESCRIPTION", "CGID", "ISERROR", "TEXT")])
SURROGATE_MAP = T.StructType(_s("placeholder", "dummy_phi"))
INDEXED_TEXT = T.StructType([T.StructField("ROW_ID", T.LongType()), T.StructField("TEXT", T.StringType())])
NAMES = T.StructType(_s("name"))
PREDICTIONS = T.StructType([*_s("patient_full_name", "cui", "preferred_name"), T.StructField("sample_index", T.IntegerType()), T.StructField("is_valid_full_name", T.BooleanType())])
#: Columns that half-corpora leave out.
UNUSED = ["HADM_ID", "CHARTDATE", "CHARTTIME", "STORETIME", "DESCRIPTION", "CGID", "ISERROR"]
