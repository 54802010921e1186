"""Which domain of experience a posting asks for: terms near career words, specific domains before general ones."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import text_batches

# Terms of the specific domains, career words, and the words that may stand between general terms and career words.
CAREER = r"(?:경력(?:직)?|경험|근무\s*이력)"
TERMS = {
    "clinical": r"(?:임상(?:\s*간호)?|병동(?:\s*간호)?|중환자실(?:\s*간호)?|응급실(?:\s*간호)?|수술실(?:\s*간호)?|외래(?:\s*간호)?|진료지원(?:\s*간호)?)",
    "health-manager": r"(?:보건\s*관리(?:자|업무|직)?|산업\s*간호(?:사|업무)?|산업\s*보건|사업장\s*(?:간호|보건)|건강\s*관리실|직업\s*건강)",
}
GENERAL = "nursing-general"
GENERAL_TERM = r"(?:간호사|간호\s*(?:업무|실무|근무)?|의료기관\s*간호)"
FILLERS = (r"(?:(?:관련|분야|업무|실무|근무|로서|로|에서|의)\s*){0,3}", r"(?:(?:관련|분야|업무|실무|근무|의)\s*){0,3}")
DETAIL_FIELDS = ("experience_requirements", "experience", "qualifications", "requirements", "preferred_qualifications", "description", "duties")
GAP, EXCERPT = 18, 140


def parts(c: Column) -> Column:
    """The clauses of a text: tags and labels of sections part lines, signs that end a sentence part clauses."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "[​﻿\r]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<\s*br\s*/?>|</(?:p|li|div|tr|h[1-6])\s*>", "\n"), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"((?:담당\s*업무|주요\s*업무|자격\s*요건|지원\s*자격|우대\s*사항)\s*[:：])", "\n$1")
    clauses = F.split(t, r"\n+|[.!?。；;]|\s*[•●▪]\s*")
    return F.filter(F.transform(clauses, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _spans(patterns: Mapping[str, str]):
    """An Arrow function: where each pattern stands in a text, as (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        known = [(k, re.compile(p, re.IGNORECASE)) for k, p in patterns.items()]
        found = [[{"kind": k, "start": m.start(), "end": m.end()} for k, p in known for m in p.finditer(t or "")] for t in texts.to_pylist()]
        return pa.array(found, kind)

    return F.arrow_udf(run, "array<struct<kind:string,start:int,end:int>>")


def _excerpt(clause: Column, start: Column, end: Column) -> Column:
    """At most 140 characters of a clause around a place, with marks where it is cut."""
    n = F.length(clause)
    at = F.greatest(F.lit(0), F.least(n - EXCERPT, start + F.floor((end - start) / 2).cast("int") - EXCERPT // 2))
    cut = F.concat(F.when(at > 0, "…").otherwise(""), F.trim(F.substring(clause, at + 1, F.lit(EXCERPT))), F.when(at + EXCERPT < n, "…").otherwise(""))
    return F.when(n <= EXCERPT, clause).otherwise(cut)


def domain_evidence(
    docs: DataFrame, *, key: str, fields: Sequence[str], terms: Mapping[str, str] = TERMS, career: str = CAREER, general: str | None = GENERAL_TERM, fillers: tuple[str, str] = FILLERS, gap: int = GAP
) -> DataFrame:
    """(key, field, field_no, pos, domain, excerpt): clauses in which a term of a domain stands within ``gap`` characters of a career word.

    Terms and career words become rows with their places; in a clause each term looks at the nearest career word before and after
    it (two windows in order of place, linear in the clause), not at every pair. A clause without a specific domain is general if a
    general term and a career word have only fillers between them.
    """
    text_batches(docs.sparkSession)
    have = [f for f in fields if f in docs.columns]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("field_no"), parts(F.col(f)).alias("clauses")) for k, f in enumerate(have)])
    rows = docs.select(key, F.explode(each).alias("f")).select(key, "f.field", "f.field_no", F.posexplode("f.clauses").alias("pos", "clause"))
    rows = rows.where(F.col("clause").rlike(f"(?i){career}"))
    spans = rows.withColumn("spans", _spans({"": career, **terms})(F.col("clause")))
    at = spans.select(key, "field", "field_no", "pos", F.explode_outer("spans").alias("s")).select(key, "field", "field_no", "pos", "s.*")
    by = Window.partitionBy(key, "field_no", "pos")
    own = F.col("kind") == ""
    before = F.max(F.when(own, F.col("end"))).over(by.orderBy("end", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(own, F.col("start"))).over(by.orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing))
    # a career word that ends where the term begins, or begins where it ends, is as near as can be
    placed = at.withColumns({"before": before, "ahead": ahead}).where(~own)
    left, right = F.col("start") - F.col("before"), F.col("ahead") - F.col("end")
    near = placed.where(left.between(0, gap) | right.between(0, gap))
    first = near.groupBy(key, "field", "field_no", "pos", F.col("kind").alias("domain")).agg(
        F.min(F.struct("start", F.greatest("end", F.when(right.between(0, gap), F.col("ahead")).otherwise(F.col("end"))).alias("end"))).alias("m")
    )
    clauses = rows.select(key, "field_no", "pos", "clause")
    specific = first.join(clauses, [key, "field_no", "pos"]).select(key, "field", "field_no", "pos", "domain", _excerpt(F.col("clause"), F.col("m.start"), F.col("m.end")).alias("excerpt"))
    if general is None:
        return specific
    pattern = rf"(?i)(?:{general}\s*{fillers[0]}{career}|{career}\s*{fillers[1]}{general})"
    rest = rows.join(first.select(key, "field_no", "pos").distinct(), [key, "field_no", "pos"], "left_anti").where(F.col("clause").rlike(pattern))
    start = F.regexp_instr("clause", F.lit(pattern)) - 1
    broad = rest.select(key, "field", "field_no", "pos", F.lit(GENERAL).alias("domain"), _excerpt(F.col("clause"), start, start + F.length(F.regexp_extract("clause", pattern, 0))).alias("excerpt"))
    return specific.unionByName(broad)


def resolve_domains(evidence: DataFrame, *, key: str, strength: str) -> DataFrame:
    """(key, domain, field, excerpt, strength) from evidence rows.

    One specific domain beats the general one; two specific ones that differ give ``unspecified`` without evidence. The first clause counts.
    """
    special = F.col("domain") != GENERAL
    order = F.struct("field_no", "pos", "domain")
    best = evidence.groupBy(key).agg(
        F.count_distinct(F.when(special, F.col("domain"))).alias("_n"),
        F.min_by(F.struct("domain", "field", "excerpt"), F.struct((~special).cast("int"), order)).alias("_e"),
    )
    one = F.col("_n") <= 1
    return best.select(
        key, F.when(one, F.col("_e.domain")).otherwise("unspecified").alias("domain"), F.when(one, F.col("_e.field")).alias("field"),
        F.when(one, F.col("_e.excerpt")).alias("excerpt"), F.when(one, F.lit(strength)).alias("strength"),
    )


def experience_domain(docs: DataFrame, *, key: str, title: str = "title", fields: Sequence[str] = DETAIL_FIELDS, **rules) -> DataFrame:
    """One row for each key: its domain and the evidence for it; the title speaks only where no detail field does."""
    detail = domain_evidence(docs, key=key, fields=fields, **rules)
    said = resolve_domains(detail, key=key, strength="explicit-detail")
    out = said
    if title in docs.columns:
        silent = docs.join(said.select(key), key, "left_anti")
        out = said.unionByName(resolve_domains(domain_evidence(silent, key=key, fields=[title], **rules), key=key, strength="title-context"))
    return docs.select(key).join(out, key, "left").withColumn("domain", F.coalesce("domain", F.lit("unspecified")))
