"""Explicit schemas of the tables that steps hand to each other."""

from pyspark.sql import types as T

from themescope.fixed_values import COLUMN_MAP, TRUTH_COLUMNS

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The raw export is text throughout; typed columns appear when it is landed.
RAW_COMPLAINTS = T.StructType(
    [T.StructField(name, _S) for name in list(COLUMN_MAP) + TRUTH_COLUMNS]
)

INPUT = _struct(
    complaint_id=_L, date=T.DateType(), product=_S, sub_product=_S, company=_S, state=_S,
    channel=_S, narrative=_S, word_count=_I,
)

TRUTH = T.StructType(
    [T.StructField("complaint_id", _L)] + [T.StructField(name, _S) for name in TRUTH_COLUMNS]
)

RESPONSES = _struct(
    dataset_id=_S, complaint_id=_L, model=_S, model_rank=_I, attempt=_I, status=_I,
    error_type=_S, raw=_S, prompt_tokens=_L, completion_tokens=_L,
)

TOPICS = T.StructType(
    INPUT.fields
    + _struct(
        all_topics_discussed=T.ArrayType(_S), supporting_quote=_S, ai_topic_reasoning=_S,
        customer_sentiment=_S, extraction_ok=_B, process_time=T.TimestampType(), model_version=_S,
    ).fields
)

CLUSTERS = T.StructType(TOPICS.fields + _struct(cluster_id=_I).fields)

OUTPUT = T.StructType(CLUSTERS.fields + _struct(general_topic_l1=_S, topic_discussed=_S).fields)

FEATURES = _struct(complaint_id=_L, model=_S, text_hash=_S, embedding=T.ArrayType(T.FloatType()))

K_SWEEP = _struct(k=_I, silhouette=_D, ari=_D, nmi=_D, inertia=_D)
