"""Declared schemas. Nothing is inferred."""
from pyspark.sql import types as T

RAW_TRANSACTIONS = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("trans_ts", T.TimestampNTZType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("gender", T.StringType()),
    T.StructField("city_pop", T.LongType()),
    T.StructField("dob", T.DateType()),
    T.StructField("is_fraud", T.IntegerType()),
])

# name in the CSV header -> (name in raw_transactions, type)
CSV_COLUMNS = {
    "trans_num": ("trans_num", T.StringType()),
    "trans_date_trans_time": ("trans_ts", T.TimestampNTZType()),
    "cc_num": ("cc_num", T.LongType()),
    "category": ("category", T.StringType()),
    "amt": ("amt", T.DoubleType()),
    "gender": ("gender", T.StringType()),
    "city_pop": ("city_pop", T.LongType()),
    "dob": ("dob", T.DateType()),
    "is_fraud": ("is_fraud", T.IntegerType()),
}
