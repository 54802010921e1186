"""Detail texts as sections and facts."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Headings of detail texts and the section they open.
HEADINGS = {"담당업무": "duties", "주요업무": "duties", "업무내용": "duties", "자격요건": "qualifications", "지원자격": "qualifications", "우대사항": "preferred", "근무조건": "conditions", "근무환경": "conditions", "복리후생": "welfare", "혜택및복지": "welfare", "전형절차": "process", "채용절차": "process", "접수방법": "apply", "지원방법": "apply", "제출서류": "documents", "기타사항": "other", "유의사항": "other"}
_BULLET = r"^\s*(?:[-•▪■□◆◇○●※·*]|\d{1,2}[.)]|[①-⑳])\s*"


def lines_of(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """(key, pos, line): the trimmed, non-empty lines of each text; a long text is its own lines and nothing else."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("pos", "line"))


def heading_key(line: Column, headings: dict[str, str]) -> Column:
    """The section that a line opens: its letters are a heading's; else null."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(line, _BULLET, ""), r"[\s\[\]【】<>():：·]+", ""))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in headings.items() for x in kv]), bare)


def assign_sections(lines: DataFrame, *, key: str, headings: dict[str, str] | None = None, limit: int = 24, is_heading: Column | None = None) -> DataFrame:
    """Each line with the section it stands in: section_no (0 is what comes before any heading), section and title; up to ``limit`` sections of a text.

    Texts are windows by themselves, so a corpus has as many as it has documents.
    """
    section = heading_key(F.col("line"), headings or HEADINGS) if is_heading is None else F.when(is_heading, F.lower("line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("_h", section).withColumn("section_no", F.count("_h").over(w))
    df = df.withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit("introduction"))).withColumn("title", F.last(F.when(F.col("_h").isNotNull(), F.col("line")), ignorenulls=True).over(w))
    return df.where(F.col("_h").isNull() & (F.col("section_no") <= limit)).drop("_h")


def join_continuations(lines: DataFrame, *, key: str) -> DataFrame:
    """Lines joined to items: a bullet or a new section starts one, a line without goes on with the one before."""
    starts = F.col("line").rlike(_BULLET) | F.col("line").rlike(r"^\[.*\]$")
    w = Window.partitionBy(key).orderBy("pos")
    df = lines.withColumn("_s", F.when(starts | F.coalesce(F.lag("section_no").over(w) != F.col("section_no"), F.lit(True)), 1).otherwise(0)).withColumn("item", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, "section_no", "section", "item").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("value"))


def label_value_pairs(lines: DataFrame, *, key: str, labels: dict[str, str]) -> DataFrame:
    """(key, pos, label, value): a label with what follows a colon, or with the next line if that is no label."""
    w = Window.partitionBy(key).orderBy("pos")
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    bare = lambda c: F.regexp_replace(c, r"[\s:：]+", "")
    own = F.try_element_at(names, bare(F.regexp_extract("line", r"^([^:：]{1,20})[:：]", 1)))
    alone = F.try_element_at(names, bare(F.col("line")))
    df = lines.withColumns({"_own": own, "_alone": alone}).withColumns({"_next": F.lead("line").over(w), "_next_is": F.lead(F.coalesce("_own", "_alone")).over(w)})
    value = F.when(F.col("_own").isNotNull(), F.trim(F.regexp_extract("line", r"^[^:：]{1,20}[:：]\s*(.*)$", 1))).when(F.col("_alone").isNotNull() & F.col("_next_is").isNull(), F.col("_next"))
    return df.withColumn("value", value).where(F.col("value").isNotNull() & (F.col("value") != "")).select(key, "pos", F.coalesce("_own", "_alone").alias("label"), "value")


def group_runs(rows: DataFrame, *, key: str, kind: str, value: str) -> DataFrame:
    """Neighbours of one kind as one block: (key, run_no, kind, values)."""
    w = Window.partitionBy(key).orderBy("pos")
    df = rows.withColumn("_b", F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)).withColumn("_n", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, F.col("_n").alias("run_no"), kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def highlights(sentences: DataFrame, definitions: Sequence[tuple[str, str]], *, key: str, need: int = 2) -> DataFrame:
    """For each definition in turn the first statement that fits and wasn't taken by one before; documents with at least ``need``."""
    df = sentences.select(key, "pos", "line", *[F.col("line").rlike(p).alias(f"_d{i}") for i, (_, p) in enumerate(definitions)])
    first = df.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col(f"_d{i}"), F.struct("pos", "line")))).alias(f"_c{i}") for i in range(len(definitions))])
    taken = F.array().cast("array<int>")
    picks = []
    for i, (name, _) in enumerate(definitions):
        first = first.withColumn(f"_p{i}", _first_free(F.col(f"_c{i}"), taken))
        picks.append(F.when(F.col(f"_p{i}").isNotNull(), F.struct(F.lit(name).alias("name"), F.col(f"_p{i}.pos").alias("pos"), F.col(f"_p{i}.line").alias("line"))))
        taken = F.array_compact(F.array(*[F.col(f"_p{j}.pos") for j in range(i + 1)]))
    return first.select(key, F.array_compact(F.array(*picks)).alias("highlights")).where(F.size("highlights") >= need)


def _first_free(found: Column, taken: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda x: ~F.array_contains(taken, x["pos"])), F.lit(1))


def recruitment_steps(c: Column, *, cap: int = 80) -> Column:
    """Steps of a process: split at arrows and bullets, numbers stripped, each once."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\s*(?:→|⇒|➜|▶|>|\n|,)\s*")
    return F.slice(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, _BULLET, ""))), lambda p: p != "")), 1, cap)


def benefits(c: Column, *, cap: int = 12) -> Column:
    """Benefits of a text, each once."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\s*[,·/•\n]\s*")
    return F.slice(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")), 1, cap)


def drop_contained(blocks: Column) -> Column:
    """Blocks without those that another one holds."""
    each = F.array_distinct(blocks)
    return F.filter(each, lambda b: ~F.exists(each, lambda o: (o != b) & o.contains(b)))


def fill_missing_sections(own: DataFrame, other: DataFrame, *, key: str) -> DataFrame:
    """Own sections, and those of other whose name and fingerprint the posting doesn't have yet."""
    mark = lambda df: df.withColumn("_f", text.fingerprint(F.col("value")))
    a, b = mark(own), mark(other)
    new = b.join(a.select(key, "section").distinct(), [key, "section"], "left_anti").join(a.select(key, "_f").distinct(), [key, "_f"], "left_anti")
    return a.unionByName(new, allowMissingColumns=True).drop("_f")


def best_fact(*columns: Column, preset: str = "detail") -> Column:
    """The first column that says something."""
    return F.coalesce(*[text.meaningful(c, preset, compose=False) for c in columns])


def capture_between(c: Column, start: str, end: str) -> Column:
    """The text between two markers, up to the end if the second is missing."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?s)(?:{start})(.*?)(?:{end}|\z)", 1)), F.lit(""))


def enrich_by_identity(postings: DataFrame, cache: DataFrame, *, fields: Sequence[str], now: Column, ttl_days: float = 7) -> DataFrame:
    """Postings with unknown fields filled from the newest fitting cache entry: by id, else by url.

    cache: (entry, ids, urls, checked_at, fields). Entries over the TTL or more than 5 minutes ahead don't count. A hit clears a tier
    made before.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    live = cache.where(age.between(-300, ttl_days * 86400))
    row = F.struct(*fields)
    pick = lambda arr, name: live.select(F.explode(arr).alias("_k"), row.alias("_v"), "checked_at", "entry").groupBy("_k").agg(F.max_by("_v", F.struct("checked_at", "entry")).alias(name))
    by_id, by_url = pick("ids", "_a"), pick("urls", "_b")
    j = postings.join(by_id.withColumnRenamed("_k", "id"), "id", "left").join(by_url.withColumnRenamed("_k", "url"), "url", "left")
    hit = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    j = j.withColumns({c: best_fact(F.col(c), F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}"))) for c in fields})
    return (j.withColumn("profile_key", F.when(~hit, F.col("profile_key"))) if "profile_key" in j.columns else j).withColumn("enriched", hit).drop("_a", "_b")


def remember_enrichment(cache: DataFrame, details: DataFrame, *, keep: int = 500) -> DataFrame:
    """Verified details join the cache; of one entry the newest fields with all ids and urls; the newest ``keep`` entries stay, which is the cache's limit."""
    both = cache.unionByName(details.where("verified").drop("verified"), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("entry", "ids", "urls", "checked_at")]
    union = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), 1, 12 if c == "ids" else 4).alias(c)
    merged = both.groupBy("entry").agg(union("ids"), union("urls"), F.max_by(F.struct(*rest), "checked_at").alias("_r"), F.max("checked_at").alias("checked_at"))
    return merged.select("entry", "ids", "urls", "checked_at", "_r.*").orderBy(F.desc("checked_at"), "entry").limit(keep)


def clause_evidence(docs: DataFrame, rules: Sequence[tuple[str, str, int]], *, key: str, text_col: str = "text") -> DataFrame:
    """(key, domain, evidence) from clauses: rules are (domain, pattern, rank), the specific ones of higher rank.

    The domain is the one of the highest rank with evidence; two of that rank that differ leave it unspecified.
    """
    clauses = docs.select(key, F.posexplode(text.split_clauses(F.col(text_col))).alias("pos", "clause"))
    hits = F.array_compact(F.array(*[F.when(F.col("clause").rlike(p), F.struct(F.lit(r).alias("rank"), F.lit(d).alias("domain"))) for d, p, r in rules]))
    rows = clauses.select(key, "pos", "clause", F.explode(hits).alias("h")).select(key, "pos", "clause", "h.*")
    best = rows.groupBy(key).agg(F.max("rank").alias("top"))
    at = rows.join(best, key).where("rank = top")
    return at.groupBy(key).agg(F.when(F.count_distinct("domain") > 1, "unspecified").otherwise(F.min("domain")).alias("domain"), F.min_by(F.substring("clause", 1, 140), F.struct("pos", "domain")).alias("evidence"))


def experience_display(level: Column, domain: Column) -> Column:
    """(value, experienced, label): the level and, for experienced posts, the domain they ask for."""
    known = F.coalesce(text.experience_level(level), F.lit("원문 확인"))
    experienced = known.rlike("경력") & ~known.rlike("무관")
    label = F.when(experienced & domain.isNotNull() & (domain != "unspecified"), F.concat(known, F.lit(" · "), domain)).otherwise(known)
    return F.struct(known.alias("value"), experienced.alias("experienced"), label.alias("label"))


def role_document_assign(roles: DataFrame, documents: DataFrame, *, key: str) -> DataFrame:
    """Each attached text goes to the one role whose department its header names; with none or several it opens a role of its own.

    roles: (key, role_no, department), documents: (key, doc_no, header), both of one posting by key.
    """
    hit = documents.join(roles, key).where((F.col("department") != "") & F.col("header").contains(F.col("department"))).select(key, "doc_no", "role_no")
    one = hit.groupBy(key, "doc_no").agg(F.count("*").alias("_n"), F.min("role_no").alias("role_no")).where("_n = 1").drop("_n")
    return documents.join(one, [key, "doc_no"], "left").withColumn("new_role", F.col("role_no").isNull())


def finalize_detail(df: DataFrame, fields: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """``verified`` where any field of the page says something, ``body_available`` for the description; unverified rows keep only the fallback fields."""
    said = lambda c: text.meaningful(F.col(c), "detail").isNotNull()
    any_of = F.lit(False)
    for c in fields:
        any_of |= said(c)
    df = df.withColumns({"verified": any_of, "body_available": said("description") if "description" in df.columns else F.lit(False)})
    return df.withColumns({c: F.when(F.col("verified"), F.col(c)) for c in fields if c not in fallback})


#: Numbered headings of official notices.
NOTICE_HEADINGS = {"모집분야": "roles", "채용분야": "roles", "모집부문": "roles", "응시자격": "qualifications", "지원자격": "qualifications", "근무조건": "conditions", "보수": "salary", "급여": "salary", "전형방법": "process", "전형절차": "process", "제출서류": "documents", "접수기간": "deadline", "원서접수": "deadline"}


def official_notice_fields(notices: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """One row for each notice with the text under its numbered headings, and headcount and deadline lines."""
    lines = assign_sections(lines_of(notices, key=key, text_col=text_col), key=key, headings=NOTICE_HEADINGS)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    by = lines.groupBy(key).pivot("section", sorted(set(NOTICE_HEADINGS.values()))).agg(body)
    facts = notices.select(key, F.regexp_extract(text_col, r"(?<!\d)(\d{1,3})\s*명", 1).try_cast("int").alias("headcount"), F.nullif(F.regexp_extract(text_col, r"(\d{4}\s*[.년-]\s*\d{1,2}\s*[.월-]\s*\d{1,2}[^\n]{0,20}까지)", 1), F.lit("")).alias("deadline_line"))
    return by.join(facts, key)


def recruitment_roles(cells: DataFrame, *, key: str, labels: dict[str, str]) -> DataFrame:
    """Roles from table cells (of explode_table): each row under a header row, one column for each labelled header.

    Lines of conditions that depend on something (``단``, ``경우``) move to notes.
    """
    head = cells.where("row_no = 0").select(key, "table_no", "col_no", F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.regexp_replace("text", r"\s+", "")).alias("field")).where("field IS NOT NULL")
    rows = cells.where("row_no > 0").join(head, [key, "table_no", "col_no"])
    out = rows.groupBy(key, "table_no", "row_no").pivot("field", sorted(set(labels.values()))).agg(F.min("text"))
    if "conditions" not in out.columns:
        return out
    depends = F.col("conditions").rlike(r"(?:^|\s)단[,.\s]|경우")
    return out.withColumn("notes", F.when(depends, F.col("conditions"))).withColumn("conditions", F.when(~depends, F.col("conditions")))


def _rich_lines(nodes: pa.Array) -> pa.Array:
    def walk(x, mark=""):
        if isinstance(x, list):
            return [line for y in x for line in walk(y, mark)]
        if not isinstance(x, dict):
            return []
        kind, inside = x.get("type"), x.get("content") or x.get("children") or []
        if kind in ("bulletList", "orderedList"):
            return [line for n, y in enumerate(inside, 1) for line in walk(y, "- " if kind == "bulletList" else f"{n}. ")]
        if x.get("text"):
            return [mark + str(x["text"])]
        lines = [line for y in inside for line in walk(y)]
        if kind in ("paragraph", "heading"):
            lines = ["".join(lines)] if lines else []
        return [mark + lines[0], *lines[1:]] if lines and mark else lines

    out = []
    for t in nodes.to_pylist():
        try:
            out.append("\n".join(walk(json.loads(t))) if t else None)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())



def rich_text_lines(c: Column) -> Column:
    """The lines of a rich-text tree given as JSON, list items bulleted or numbered."""
    return F.arrow_udf(_rich_lines, "string")(c)
