"""JSON of any shape as VARIANT: trees level by level, details by paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: What careers and states are called in platform JSON.
CAREERS = {"NEW": "신입", "CAREER": "경력", "NEW_CAREER": "신입·경력", "ANY": "경력무관"}


@dataclass(frozen=True)
class DetailSpec:
    """Where a platform's detail JSON has a posting's fields: paths in order of preference, below ``root``.

    Arrays of strings are joined by ``·``. codes give the words of coded fields; a detail is closed if ``status`` is there and isn't ``active``.
    """

    fields: Mapping[str, Sequence[str]]
    root: str = "$"
    codes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    rich: str | None = None
    status: str | None = None
    active: str = "ACTIVE"


ZIGHANG = DetailSpec(
    {"title": ["title"], "company": ["company.name"], "employment": ["employeeTypes"], "education": ["educations"], "region": ["regions"], "published_at": ["createdAt"], "deadline": ["endDate"], "original_url": ["redirectUrl"]},
    root="$.data", rich="summary", status="status",
)
EUMC = DetailSpec({"title": ["title"], "description": ["content"], "published_at": ["start"], "deadline": ["end"]}, root="$.data")
KUMC = DetailSpec(
    {"title": ["title"], "description": ["jobDescription"], "employment": ["recruitmentType"], "experience": ["careerType"], "company": ["classificationCode"], "published_at": ["startDateTime"], "deadline": ["endDateTime"]},
    codes={"experience": CAREERS},
)


def json_value(body: Column, paths: Sequence[str], root: str = "$") -> Column:
    """The first of the paths that has a value, as text; arrays of strings joined by ``·``; null where body is no JSON."""
    tree = F.try_parse_json(body)
    tried = []
    for p in paths:
        at = f"{root}.{p}"
        several = F.try_variant_get(tree, at, "array<string>")
        tried.append(F.nullif(F.when(several.isNotNull(), F.array_join(several, " · ")).otherwise(F.try_variant_get(tree, at, "string")), F.lit("")))
    return F.coalesce(*tried)


def posting_of_detail(details: DataFrame, spec: DetailSpec, *, key: str, body: str = "body") -> DataFrame:
    """Details with a posting's columns by spec, ``is_json`` and ``closed``; with ``rich`` the description is the text of that tree."""
    tree = F.try_parse_json(body)
    cols: dict[str, Column] = {}
    for name, paths in spec.fields.items():
        value = json_value(F.col(body), paths, spec.root)
        if name in spec.codes:
            words = F.create_map(*[F.lit(x) for kv in spec.codes[name].items() for x in kv])
            value = F.try_element_at(words, value)
        cols[name] = value
    state = F.try_variant_get(tree, f"{spec.root}.{spec.status}", "string") if spec.status else F.lit(None).cast("string")
    out = details.withColumns(cols | {"is_json": tree.isNotNull(), "closed": F.coalesce((state != "") & (state != spec.active), F.lit(False))})
    if spec.rich is None:
        return out
    roots = details.select(F.col(key), F.try_variant_get(tree, f"{spec.root}.{spec.rich}", "variant").alias("node"))
    return out.join(rich_texts(roots, key=key).withColumnRenamed("text", "description"), key, "left")


def _levels(roots: DataFrame, key: str, children: str) -> list[DataFrame]:
    """The nodes of trees, a table for each depth: (key, at, node, inside), at being the places on the way down."""
    now = roots.select(key, F.array().cast("array<int>").alias("at"), "node").where("node is not null")
    out = []
    while True:
        now = stored(now.withColumn("inside", F.try_variant_get("node", f"$.{children}", "variant")), "variant-level")
        if now.isEmpty():
            return out
        out.append(now)
        deeper = now.where("inside is not null").select(F.col(key).alias("_key"), F.col("at").alias("_at"), "inside")
        deeper = deeper.lateralJoin(now.sparkSession.tvf.variant_explode(F.col("inside").outer()))
        now = deeper.select(F.col("_key").alias(key), F.concat("_at", F.array("pos")).alias("at"), F.col("value").alias("node"))


def rich_texts(roots: DataFrame, *, key: str) -> DataFrame:
    """(key, text) for trees (key, node variant) of rich text: list items bulleted or numbered, blocks apart by an empty line.

    Trees are unfolded a level at a time by ``variant_explode`` and folded back from the deepest, so depth costs rounds and no walk
    runs in one row: every node is a row. Keys name one tree each. A tree without text gives an empty one, a null node null. Texts are whole, however long.
    """
    levels = _levels(roots, key, "content")
    done = None
    for depth, level in reversed(list(enumerate(levels))):
        kind, own = F.try_variant_get("node", "$.type", "string"), F.try_variant_get("node", "$.text", "string")
        if done is None:
            nodes = level.withColumn("kids", F.array().cast("array<string>"))
        else:
            parts = done.groupBy(key, F.slice("at", 1, depth).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("at", -1).alias("pos"), "text"))).alias("kids"))
            # merged and not broadcast: a level's files are far smaller than its rows, and there is one join for each depth
            nodes = level.hint("merge").join(parts.withColumn("kids", F.col("kids.text")), [key, "at"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<string>")))
        trimmed = F.transform("kids", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        bullets = F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.concat(F.lit("• "), x))
        numbers = F.filter(F.transform(trimmed, lambda x, i: F.when(x != "", F.concat((i + 1).cast("string"), F.lit(". "), x))), lambda x: x.isNotNull())
        full = F.filter("kids", lambda x: x != "")
        text = (
            F.when(kind == "text", F.coalesce(own, F.lit(""))).when(kind == "hardBreak", "\n").when(kind == "bulletList", F.array_join(bullets, "\n")).when(kind == "orderedList", F.array_join(numbers, "\n"))
            .when(kind == "doc", F.array_join(full, "\n\n")).when(kind == "listItem", F.array_join(full, "\n")).otherwise(F.array_join("kids", ""))
        )
        done = nodes.select(key, "at", text.alias("text"))
        if depth % 4 == 0:
            done = stored(done, "variant-folded")
    if done is None:
        return roots.select(key, F.lit(None).cast("string").alias("text")).limit(0)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return done.select(key, tidy.alias("text"))


def first_of_type(roots: DataFrame, wanted: str, *, key: str, depth: int = 12) -> DataFrame:
    """(key, node): the first object, depth first, whose ``@type`` is or holds ``wanted``, in trees (key, node variant) of arrays and objects.

    Levels are unfolded to ``depth``; of the objects found the first in order of the places on the way down counts, an outer one before inner ones.
    """
    now = roots.select(key, F.array().cast("array<int>").alias("at"), "node").where("node is not null")
    found = None
    for _ in range(depth):
        now = stored(now, "variant-typed")
        if now.isEmpty():
            break
        kind = F.coalesce(F.try_variant_get("node", "$['@type']", "array<string>"), F.array(F.try_variant_get("node", "$['@type']", "string")))
        hits = now.where(F.coalesce(F.array_contains(kind, wanted), F.lit(False)))
        found = hits if found is None else found.unionByName(hits)
        inside = now.select(F.col(key).alias("_key"), F.col("at").alias("_at"), "node").lateralJoin(now.sparkSession.tvf.variant_explode(F.col("node").outer()))
        now = inside.select(F.col("_key").alias(key), F.concat("_at", F.array("pos")).alias("at"), F.col("value").alias("node"))
    if found is None:
        return roots.limit(0)
    return found.groupBy(key).agg(F.min_by(F.to_json("node"), "at").alias("j")).select(key, F.try_parse_json("j").alias("node"))
