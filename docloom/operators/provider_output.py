"""Answers of a generation provider to record candidates.

Answers come as JSON text in several shapes: an object or list of records, a chat result (alone or in
a list) whose first choice holds the text, text in a code fence, or text with words before and after
the object. The native parser covers all of them; what it cannot read becomes a row with an error code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_blank, strip

EVIDENCE = "array<struct<source_ref:string,quote:string>>"
RECORD = f"struct<instruction:string,context:string,input:string,expected_output:string,output:string,category:string,difficulty:string,source_refs:array<string>,evidence:{EVIDENCE},metadata:map<string,string>>"

#: Keys of provider metadata that the application owns.
OWNED_METADATA = ("record_id", "generation_id", "file_id", "source_refs", "evidence")


#: Fields of which a record has at least one.
_FIELDS = ("instruction", "context", "input", "expected_output", "output", "category", "difficulty", "source_refs", "evidence")


def unfenced(text: Column) -> Column:
    """Text without a surrounding code fence, from its first brace or bracket."""
    body = strip(F.coalesce(text, F.lit("")))
    body = F.when(body.startswith("```"), F.regexp_extract(body, r"(?s)^```[^\n]*\n(.*?)(?:```[^`]*)?$", 1)).otherwise(body)
    return F.when(body.rlike(r"^\s*[\[{]"), body).otherwise(F.regexp_extract(body, r"(?s)^[^{]*(\{.*)$", 1))


def _kind(value: Column) -> Column:
    """Type of a variant, such as STRING, OBJECT<...> or ARRAY<...>; null if there is no value."""
    return F.schema_of_variant(value)


def with_answer(raw: DataFrame, output: str = "output") -> DataFrame:
    """``raw`` with __answer (the result as a variant, parsed once), __text (what the assistant said) and __failed.

    A list of one object that has choices, wherever that key stands in it, is the object. __text is
    the first choice's message content, text or output, never its reasoning, and null where a choice
    has none; without choices it is the result where that is text, JSON or not. __failed says that
    the result is an object with an error object.
    """
    value = raw.withColumn("__value", F.try_parse_json(output))
    item = F.try_variant_get("__value", "$[0]", "variant")
    wrapped = F.try_variant_get("__value", "$[0].choices", "variant").isNotNull() & F.try_variant_get("__value", "$[1]", "variant").isNull()
    value = value.withColumn("__answer", F.when(wrapped, item).otherwise(F.col("__value"))).drop("__value")

    def said(path: str) -> Column:
        text = F.when(_kind(F.try_variant_get("__answer", path, "variant")) == "STRING", F.try_variant_get("__answer", path, "string"))
        return F.when(~is_blank(text), text)

    chosen = F.coalesce(*(said(f"$.choices[0].{p}") for p in ("message.content", "text", "output")))
    plain = F.when(F.col("__answer").isNull(), F.col(output)).when(_kind(F.col("__answer")) == "STRING", F.try_variant_get("__answer", "$", "string"))
    has_choices = F.try_variant_get("__answer", "$.choices", "variant").isNotNull()
    failed = F.coalesce(_kind(F.try_variant_get("__answer", "$.error", "variant")).startswith("OBJECT"), F.lit(False))
    return value.withColumn("__text", F.when(has_choices, chosen).otherwise(plain)).withColumn("__failed", failed)


def assistant_content(raw: DataFrame, output: str = "output") -> DataFrame:
    """``raw`` with content: the assistant's text, or the whole result as JSON where it is a record object or list itself."""
    has_choices = F.try_variant_get("__answer", "$.choices", "variant").isNotNull()
    whole = F.when(F.col("__answer").isNotNull() & ~has_choices, F.to_json("__answer"))
    return with_answer(raw, output).withColumn("content", F.coalesce("__text", whole)).drop("__answer", "__text", "__failed")


def parse_outputs(raw: DataFrame, output: str = "output") -> DataFrame:
    """One row a record candidate: the columns of ``raw`` but the output, then rec_in_batch (from 0), item (struct) and error.

    Outputs without records, or with an item that is no object or has no field of a record, give one
    row with an error (WORKER_ERROR or STRUCTURED_OUTPUT_INVALID) and no item. A null output is
    invalid; an empty table gives an empty result.
    """
    keys = [c for c in raw.columns if c != output]
    answered = with_answer(raw, output)
    body = unfenced(F.col("__text"))
    inside = F.when(body.startswith("["), body).otherwise(F.get_json_object(body, "$.records"))
    held = F.coalesce(F.try_variant_get("__answer", "$.records", "variant"), F.when(_kind(F.col("__answer")).startswith("ARRAY"), F.col("__answer")))
    has_choices = F.try_variant_get("__answer", "$.choices", "variant").isNotNull()
    listed = answered.withColumn("__list", F.when(F.col("__text").isNotNull(), inside).when(~F.coalesce(has_choices, F.lit(False)), F.to_json(held)))
    items = listed.withColumn("__raw", F.from_json(F.when(F.col("__list").startswith("["), F.col("__list")), "array<string>")).withColumn("__items", F.from_json("__list", f"array<{RECORD}>"))
    foreign = F.exists("__raw", lambda x: x.isNull() | ~x.startswith("{")) | F.exists("__items", lambda i: i.isNull() | F.forall(F.array(*(i.getField(f).isNotNull() for f in _FIELDS)), lambda has: ~has))
    invalid = (F.coalesce(F.size("__items"), F.lit(-1)) <= 0) | F.col("__raw").isNull() | F.coalesce(foreign, F.lit(True))
    error = F.when(F.col("__failed"), "WORKER_ERROR").when(invalid, "STRUCTURED_OUTPUT_INVALID")
    parsed = items.select(*keys, F.when(error.isNull(), F.col("__items")).alias("items"), error.alias("error"))
    return parsed.select(*keys, "error", F.posexplode_outer("items").alias("rec_in_batch", "item"))


def normalize_records(parsed: DataFrame, generation_id: Column, file_id: Column, owned: dict[str, Column]) -> DataFrame:
    """Candidates as records: fall-backs of older field names, defaults, mirrored fields, and metadata owned by the application.

    ``owned`` has further metadata (provider, model, prompt version, creation time), which the caller
    injects so that results do not depend on a clock.
    """
    item = lambda f: F.col(f"item.{f}")
    context = F.coalesce(item("context"), item("input"), F.lit(""))
    answer = F.coalesce(item("expected_output"), item("output"), F.lit(""))
    kept = F.map_filter(F.coalesce(item("metadata"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*OWNED_METADATA, *owned))
    own = {"record_id": F.concat(generation_id, F.lit("-"), (F.col("rec_in_batch") + 1).cast("string")), "generation_id": generation_id, "file_id": file_id, **owned}
    metadata = F.map_concat(kept, F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]))
    rest = [c for c in parsed.columns if c not in ("item", "error")]
    return parsed.where(F.col("item").isNotNull()).select(
        *rest,
        F.coalesce(item("instruction"), F.lit("")).alias("instruction"),
        context.alias("input_text"),
        answer.alias("output_text"),
        context.alias("context"),
        answer.alias("expected_output"),
        F.coalesce(item("category"), F.lit("general")).alias("category"),
        F.coalesce(item("difficulty"), F.lit("medium")).alias("difficulty"),
        F.coalesce(item("source_refs"), F.array().cast("array<string>")).alias("source_refs"),
        F.coalesce(item("evidence"), F.array().cast(EVIDENCE)).alias("evidence"),
        metadata.alias("metadata"),
    )


def output_shape(output: Column) -> Column:
    """What kind of value a provider returned, without its content: type, keys, number of choices, length."""
    body = F.trim(F.coalesce(output, F.lit("")))
    kind = F.when(output.isNull(), "null").when(body.startswith("{"), "object").when(body.startswith("["), "list").otherwise("text")
    return F.struct(kind.alias("kind"), F.array_sort(F.coalesce(F.json_object_keys(F.when(body.startswith("{"), body)), F.array().cast("array<string>"))).alias("keys"), F.coalesce(F.json_array_length(F.get_json_object(body, "$.choices")), F.lit(0)).alias("choices"), F.length(body).alias("characters"))
