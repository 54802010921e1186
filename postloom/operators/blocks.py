"""Lines of details as readable blocks: labels with the line after them, wrapped lines joined, one line after another."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# What a line looks like, by the first that fits, and which labels name a field.
BULLET, GROUP, NOTE = r"^[-–—•●▪·ㆍ◆◇▶▷✓✔✅]\s*", r"^□\s*", r"^※\s*"
BRACKETED, NUMBERED = r"^\[([^\]]{1,40})\]$", r"^(\d{1,2})[.)]\s+(.{2,60})$"
TABLE_LABEL = r"^(?:구\s*분|내\s*용|인원|제한|경쟁|필수|우대|유형|보수|공통|직무기술서|채용분야)$"
STANDALONE = r"^(?:\d+|행정직|총무|안전팀|시스템|개발팀|정규직|계약직|기간제|시간제|\d+~\d+급|\(주임~|대리급\)|원서접수|서류전형|면접전형)$"
INLINE_HEADING = r"^(?:모집요강|상세요강|채용담당자 정보|담당자 정보)$"
SOURCE_NOTE = r"사정상 조기 마감|본 정보는 .+에서 제공|채용정보 제공 \["
EMPTY_VALUE = r"^(?:[|｜¦‖]+|[-–—]{1,3}|없음|미표기|--?|(?i:(?:Tel\s*:)?\s*핸드폰\s*:\s*팩스\s*:\s*--?))$"
CONTINUES = r"^(?:및|또는|등|각|제\d+조|시행|운영|관리|업무|지원|지급|결정|선정|점수|결과)"
FIELD_LABELS = {
    "모집분야": "모집 분야", "채용분야": "모집 분야", "모집부문": "모집 부문", "근무지": "근무지", "근무지역": "근무지", "모집인원": "모집 인원",
    "채용인원": "모집 인원", "고용형태": "고용 형태", "채용형태": "고용 형태", "근무형태": "근무 형태", "근무시간": "근무 시간",
}
GENERIC = {("모집 부문", "기타"), ("고용 형태", "기타")}
UNSAID = {("모집 인원", "0명"): "공고에서 확인 필요", ("모집 인원", "0 명"): "공고에서 확인 필요"}
FRAGMENTS, BLOCKS = 6, 120

_OUT = "`{key}` {kind}, block_no int, pos int, type string, label string, text string"


def line_kinds(lines: DataFrame, *, labels: dict[str, str] | None = None) -> DataFrame:
    """lines (key, pos, line) with ``kind``, ``body`` (without its mark) and ``label``; lines without a body are left out. Columns only."""
    line = F.trim(F.regexp_replace("line", r"[ \t  ]+", " "))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, GROUP, ""), NOTE, ""), BULLET, ""), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for kv in (labels or FIELD_LABELS).items() for x in kv])
    label = F.try_element_at(names, F.regexp_replace(body, r"[\s:：]+", ""))
    loose = F.length(body) <= 16
    fragment = loose & ~body.rlike(r"[.!?。,:：;；]") & (body.rlike(TABLE_LABEL) | (F.size(F.split(body, r"\s+")) <= 3))
    kind = (
        F.when(line.rlike(BRACKETED), "bracketed").when(body.rlike(INLINE_HEADING), "inline").when(label.isNotNull(), "label").when(line.rlike(GROUP), "group").when(line.rlike(NOTE), "note")
        .when(line.rlike(BULLET), "bullet").when(line.rlike(NUMBERED), F.when(F.length(line) <= 64, "numbered").when(fragment, "numbered-fragment").otherwise("numbered-text")).when(fragment, "fragment").otherwise("text")
    )
    shown: Column = F.when(line.rlike(BRACKETED), F.trim(F.regexp_extract(line, BRACKETED, 1))).when(F.col("kind") == "numbered", F.trim(F.regexp_extract(line, NUMBERED, 2))).otherwise(body)
    return lines.withColumns({"kind": kind, "label": label, "stripped": body}).withColumn("body", shown).where("stripped <> ''")


class _Blocks:
    """Blocks of one document: its lines come in order, the newest block is held as long as a line may go on with it."""

    def __init__(self) -> None:
        self.key, self.held, self.label, self.n = None, None, None, 0

    def _open(self, pos: int, kind: str, label: str | None, text: str) -> Iterator[tuple]:
        yield from self._close()
        self.held = [pos, kind, label, text, 1]

    def _close(self) -> Iterator[tuple]:
        if self.held is not None and self.n < BLOCKS:
            pos, kind, label, text, _ = self.held
            self.n += 1
            yield (self.key, self.n, pos, kind, label, text)
        self.held = None

    def _goes_on(self, text: str) -> bool:
        if self.held is None or self.held[1] not in ("bullet", "note") or re.match(TABLE_LABEL, text) or re.match(STANDALONE, text):
            return False
        before = self.held[3]
        return bool(re.search(r"[,，(/]$", before) or not re.search(r"[.!?。]$", before) or re.match(CONTINUES, text))

    def eval(self, row) -> Iterator[tuple]:
        self.key = row[0]
        pos, kind, label, body, stripped = row["pos"], row["kind"], row["label"], row["body"], row["stripped"]
        if self.label is not None:
            at, name = self.label
            self.label = None
            if kind not in ("bracketed", "inline", "label"):
                value = UNSAID.get((name, stripped), stripped)
                if (name, value) not in GENERIC and not re.match(EMPTY_VALUE, value):
                    yield from self._open(at, "field", name, value)
                return
        if kind == "label":
            self.label = (pos, label)
        elif kind in ("text", "fragment") and self._goes_on(stripped):
            self.held[3] = f"{self.held[3]} {stripped}"
        elif kind in ("bracketed", "inline", "numbered"):
            yield from self._open(pos, "subheading", None, body)
        elif kind == "group":
            yield from self._open(pos, "bullet" if re.match(r"^\([^)]{1,30}\)", stripped) else "subheading", None, stripped)
        elif kind == "note" or (kind == "bullet" and re.search(SOURCE_NOTE, stripped)):
            yield from self._open(pos, "note", None, stripped)
        elif kind == "bullet":
            yield from self._open(pos, "bullet", None, stripped)
        elif kind.endswith("fragment"):
            if self.held is not None and self.held[1] == "fragment" and self.held[4] < FRAGMENTS:
                self.held[3] += f"\n{stripped}"
                self.held[4] += 1
            else:
                yield from self._open(pos, "fragment", None, stripped)
        else:
            yield from self._open(pos, "text", None, stripped)

    def terminate(self) -> Iterator[tuple]:
        yield from self._close()


def readable_blocks(lines: DataFrame, *, key: str, labels: dict[str, str] | None = None) -> DataFrame:
    """(key, block_no, pos, type, label, text): the blocks of each document's lines (key, pos, line), at most 120.

    What a line looks like is worked out in columns; the greedy part, which looks at the block before it and the line after a
    label, is a table function over the lines of a key in order. It holds one block at a time, so a document of any length
    streams through; documents are dealt by key. Fragments of a block are lines of its text. Null lines are left out.
    """
    kinds = line_kinds(lines, labels=labels).select(key, "pos", "kind", "label", "body", "stripped")
    out = _OUT.format(key=key, kind=lines.schema[key].dataType.simpleString())
    return udtf(_Blocks, returnType=out)(kinds.asTable().partitionBy(key).orderBy("pos"))
