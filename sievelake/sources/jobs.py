"""Jobs of the prompt writer: a deterministic table made from constants, and prompts rendered from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics by domain; wanted prompts, prompts a call and surplus of each task; number of passage bands.
DOMAINS = {
    "history": ["ancient Ethiopian kingdoms (Aksum)", "Battle of Adwa", "Ethiopian calendar and holidays", "African independence movements", "ancient world civilizations", "20th century world events"],
    "health": ["malaria prevention", "maternal and child health", "nutrition and balanced diet", "hygiene and sanitation", "vaccination", "common first aid"],
    "science": ["water cycle and weather", "photosynthesis and plants", "human body systems", "electricity and energy", "earth and space", "simple chemistry in daily life"],
    "agriculture": ["teff and cereal farming", "coffee production", "soil conservation", "livestock care", "irrigation and water use", "pest and crop disease management"],
    "news": ["local community events", "economy and markets", "education developments", "environment and climate", "transport and infrastructure", "sports"],
    "technology": ["mobile phones and mobile money", "internet and social media", "artificial intelligence basics", "renewable energy and solar", "computer basics", "digital safety"],
    "daily_life": ["cooking and food culture", "family and relationships", "markets and shopping", "travel and transport", "school life", "festivals and traditions"],
}
TARGETS = {"knowledge": 500, "comprehension": 500, "translation": 500, "summarisation": 500}
ITEMS_PER_CALL = {"knowledge": 10, "comprehension": 3, "translation": 8, "summarisation": 3}
SURPLUS = {"knowledge": 1.2, "comprehension": 5.0, "translation": 1.2, "summarisation": 5.0}
BANDS = {"comprehension": 4, "summarisation": 4}
CONTEXT_SHARE = {"comprehension": 0.7, "summarisation": 0.7, "translation": 0.75}
BARE_SHARE = 0.4
SEED = 42


def coin(seed: int, label: str, *ids: Column) -> Column:
    """A number in [0, 1) by MD5, the same in every engine."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(label), *ids))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def writer_jobs(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """(id, task, i, n, domain, sub, ctx, band, style, direction): for each task as many calls as its target needs with
    its surplus; topics in turn, shifted by one each round; bands and directions in turn."""
    topics = [(d, s) for d, subs in DOMAINS.items() for s in subs]
    size = len(topics)
    counts = [(t, -(-int(TARGETS[t] * SURPLUS[t]) // ITEMS_PER_CALL[t]), ITEMS_PER_CALL[t], BANDS.get(t)) for t in TARGETS]
    tasks = spark.createDataFrame(counts, "task string, jobs int, n int, bands int")
    rows = tasks.select("task", "n", "bands", F.explode(F.sequence(F.lit(0), F.col("jobs") - 1)).alias("i"))
    topic = F.get(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in topics)), F.pmod(F.col("i") + F.floor(F.col("i") / size), F.lit(size)).cast("int"))
    rows = rows.withColumn("t", topic).withColumn("id", F.concat_ws("|", "task", "i"))
    passage = F.col("bands").isNotNull()
    style = F.when(F.col("t.d") == "news", "NEWS").when(coin(seed, "style", F.col("id")) < 0.5, "NEWS").otherwise("EXPLAINER")
    return rows.select(
        "id", "task", "i", "n",
        F.col("t.d").alias("domain"), F.col("t.s").alias("sub"),
        F.when(coin(seed, "ctx", F.col("id")) < 0.5, "ETHIOPIAN").otherwise("GLOBAL").alias("ctx"),
        (F.col("i") % F.col("bands")).alias("band"),
        F.when(passage, style).alias("style"),
        F.when(F.col("task") == "translation", F.when(F.col("i") % 2 == 0, "EN2AM").otherwise("AM2EN")).alias("direction"),
    )


#: Plain layouts and instructions for the context layout, of which each row draws one; callers pass their own reviewed wordings.
LAYOUTS = {
    "knowledge": ["{q}", "Question: {q}\n\nAnswer:", "Please answer: {q}", "Answer in a few words.\n{q}"],
    "comprehension": ["Read the text and answer.\n\n{p}\n\n{q}", "{p}\n\nFrom this text: {q}", "Text: {p}\n\nQuestion: {q}"],
    "summarisation": ["Sum up this text.\n\n{p}", "{p}\n\nWhat does this say, in short?", "Give the main points of the following.\n\n{p}"],
    "EN2AM": ["Translate into Amharic:\n\n{t}", "How is this said in Amharic? {t}"],
    "AM2EN": ["Translate into English:\n\n{t}", "How is this said in English? {t}"],
}
INSTRUCTIONS = {
    "comprehension": ["Answer the question from the text.", "Use the text below to answer.", "What does the text say to this question?"],
    "summarisation": ["Sum up the text.", "Write a short summary.", "State the main idea of the text."],
    "EN2AM": ["Put this into Amharic.", "Write the text in Amharic."],
    "AM2EN": ["Put this into English.", "Write the text in English."],
}


def rendered(df: DataFrame, layouts: dict[str, list[str]] = LAYOUTS, instructions: dict[str, list[str]] = INSTRUCTIONS, seed: int = SEED) -> DataFrame:
    """``df`` (id, task, direction, content: question, passage, text) with ``prompt`` and ``template_id``.

    A draw by id picks the context layout (instruction, mark, text, question) or one of the task's layouts; for
    knowledge the bare question has a share of its own.
    """
    kind = F.when(F.col("task") == "translation", F.col("direction")).otherwise(F.col("task"))
    q, p, t = (F.coalesce(F.col(f"content.{c}"), F.lit("")) for c in ("question", "passage", "text"))
    body = F.when(F.col("task") == "comprehension", F.concat_ws("\n\n", p, q)).when(F.col("task") == "summarisation", p).otherwise(t)
    first, second = coin(seed, "layout", F.col("id")), coin(seed, "wording", F.col("id"))

    def pick(table: dict[str, list[str]]) -> tuple[Column, Column]:
        wording, at = F.lit(None).cast("string"), F.lit(None).cast("int")
        for name, options in table.items():
            k = F.floor(second * len(options)).cast("int")
            at = F.when(kind == name, k).otherwise(at)
            wording = F.when(kind == name, F.get(F.array(*map(F.lit, options)), k)).otherwise(wording)
        return wording, at

    instruction, at_i = pick(instructions)
    layout, at_l = pick(layouts)
    bare = layouts["knowledge"].index("{q}")
    is_bare = (F.col("task") == "knowledge") & (first < BARE_SHARE)
    share = F.lit(0.0)
    for name, s in CONTEXT_SHARE.items():
        share = F.when(F.col("task") == name, s).otherwise(share)
    in_context = first < share
    layout, at_l = F.when(is_bare, F.lit("{q}")).otherwise(layout), F.when(is_bare, F.lit(bare)).otherwise(at_l)
    plain = F.replace(F.replace(F.replace(layout, F.lit("{q}"), q), F.lit("{p}"), p), F.lit("{t}"), t)
    return df.withColumn("prompt", F.when(in_context, F.concat(instruction, F.lit("\n\nContext:\n"), body)).otherwise(plain)).withColumn(
        "template_id", F.when(in_context, F.concat(kind, F.lit("-ctx"), at_i.cast("string"))).otherwise(F.concat_ws("-", kind, at_l.cast("string")))
    )


def usable_content(df: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose content has all of their task's fields, stripped and with single blanks, none empty."""
    from ..functions.text import clean_spaces, strip

    fields = df.schema["content"].dataType.names
    cleaned = F.struct(*(clean_spaces(strip(F.coalesce(F.col(f"content.{f}"), F.lit("")))).alias(f) for f in fields))
    df = df.withColumn("content", cleaned)
    ok = F.lit(False)
    for task, ks in keys.items():
        full = F.lit(True)
        for k in ks:
            full = full & (F.col(f"content.{k}") != "")
        ok = F.when(F.col("task") == task, full).otherwise(ok)
    return df.filter(ok)
