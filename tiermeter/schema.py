"""The nested decision row, as Spark DDL, and builders for its parts."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint>"
COMPLETION = f"struct<text:string,model:string,usage:{USAGE},cost_usd:double,latency_s:double,stop_reason:string,logprobs:array<double>,cached:boolean,meta:string>"
CONFIDENCE = f"struct<estimator:string,score:double,calls:array<{COMPLETION}>,detail:string>"
JUDGEMENT = f"struct<equivalent:boolean,comparator:string,calls:array<{COMPLETION}>,detail:string>"
ATTEMPT = f"struct<tier:string,backend:string,answer:string,threshold:double,accepted:boolean,error:string,completion:{COMPLETION},confidence:{CONFIDENCE},correct:{JUDGEMENT},agreement:{JUDGEMENT}>"
SHADOW = f"struct<audit_tier:string,inclusion_prob:double,status:string,attempt:{ATTEMPT},agreement:{JUDGEMENT}>"
TASK = "struct<id:string,prompt:string,reference:string,meta:string>"
DECISION = (
    f"run_id string, seq bigint, mode string, task {TASK}, answer string, final_tier string, escalated boolean, "
    f"attempts array<{ATTEMPT}>, shadow {SHADOW}, cost_usd double, audit_cost_usd double, latency_s double, correct {JUDGEMENT}, created_at string, error string"
)


def struct_of(kind: str, **fields: Column) -> Column:
    """A struct of the DDL type ``kind``; fields that aren't given are null."""
    given = T._parse_datatype_string(kind)
    unknown = set(fields) - set(given.names)
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in given])


def judgement(equivalent: Column, comparator: str = "normalized") -> Column:
    """A judgement; null where ``equivalent`` is null and there was nothing to compare."""
    return struct_of(JUDGEMENT, equivalent=equivalent, comparator=F.lit(comparator), calls=F.array())
