"""The sources as rows: id, name, address, how they are read and in what format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Boards by format, and those that are only linked to.
SOURCES = {
    "html": "nursejob saramin jobkorea catch alio nurselink kaohn kisanhyup snuh amc samsung medicaljob hospitaljob rnjob cmc khmc kuh casemanager nmc bohun nursenet hallym incruit",
    "json": "zighang wanted snubh ncc yuhs paik kumc smc eumc",
    "xml": "work24",
    "import": "nurscape",
    "link": "indeed smartnurse snu-nursing yonsei-wonju-nursing gilhospital ajich",
}

# Names and addresses of the sources.
ADDRESSES = {
    "zighang": ("직행", "https://zighang.com/"),
    "nurscape": ("너스케입", "https://recruit.nurscape.net/Jobs/List"),
    "nurselink": ("널스링크", "https://nurse-link.co.kr/jobs?jobCategoryIds=26"),
    "rnjob": ("RNJOB", "https://rnjob.koreanursing.or.kr/"),
    "medicaljob": ("메디컬잡", "https://www.medicaljob.co.kr/job/"),
    "hospitaljob": ("병원잡", "https://www.byeongwonjob.com/cms/s01.php"),
    "kaohn": ("직업건강협회", "https://www.kaohn.or.kr/board/bbs81_1"),
    "kisanhyup": ("산업보건협의회", "https://kisanhyup.co.kr/bbs/board.php?bo_table=bd_num7"),
    "saramin": ("사람인", "https://www.saramin.co.kr/zf_user/search?searchType=search&searchword=%EC%83%81%EA%B7%BC%20%EA%B0%84%ED%98%B8%EC%82%AC"),
    "indeed": ("Indeed", "https://kr.indeed.com/jobs?q=%EC%83%81%EA%B7%BC%EC%A7%81+%EA%B0%84%ED%98%B8%EC%82%AC&fromage=14&sort=date"),
    "jobkorea": ("잡코리아", "https://www.jobkorea.co.kr/Search/?stext=%EB%B3%B4%EA%B1%B4%EA%B4%80%EB%A6%AC%EC%9E%90"),
    "catch": ("캐치", "https://www.catch.co.kr/Search/SearchList?Keyword=%EB%B3%B4%EA%B1%B4%EA%B4%80%EB%A6%AC%EC%9E%90"),
    "work24": ("고용24", "https://www.work24.go.kr/wk/a/b/1200/retriveDtlEmpSrchList.do"),
    "wanted": ("원티드", "https://www.wanted.co.kr/search?query=%EB%B3%B4%EA%B1%B4%EA%B4%80%EB%A6%AC%EC%9E%90&tab=position"),
    "alio": ("JOB-ALIO", "https://job.alio.go.kr/recruit.do"),
    "nursejob": ("널스잡", "https://www.nursejob.co.kr/recruit/list.php?tch=nurse&m=new"),
    "snuh": ("서울대병원", "https://recruit.snuh.org/main.do"),
    "snubh": ("분당서울대병원", "https://snubh.recruiter.co.kr/"),
    "amc": ("서울아산병원", "https://recruit.amc.seoul.kr/recruit/main.do"),
    "samsung": ("삼성서울병원", "https://www.samsunghospital.com/home/recruit/main.do"),
    "ncc": ("국립암센터", "https://ncc.recruiter.co.kr/"),
    "cmc": ("가톨릭의료원", "https://recruit.cmcnu.or.kr/"),
    "smartnurse": ("스마트널스", "https://www.smartnurse.co.kr/recruitmentnews/"),
    "casemanager": ("보험심사간호사회", "https://www.casemanager.or.kr/bbs/board.php?bo_table=recruit_people"),
    "snu-nursing": ("서울대 간호대학", "https://nursing.snu.ac.kr/board/job-openings"),
    "yonsei-wonju-nursing": ("연세대 원주간호", "https://nursing.yonsei.ac.kr/board/employment_data"),
    "yuhs": ("연세의료원", "https://yuhs.recruiter.co.kr/"),
    "eumc": ("이화의료원", "https://eumc.applyin.co.kr/"),
    "paik": ("백병원", "https://paik.recruiter.co.kr/"),
    "hallym": ("한림대의료원", "https://recruit.hallym.or.kr/"),
    "gilhospital": ("가천대 길병원", "https://gilhospital.recruiter.co.kr/appsite/company/index"),
    "khmc": ("경희의료원", "https://recruit.incruit.com/khmc/job/"),
    "ajich": ("아주대요양병원", "https://www.ajich.or.kr/web/notice/recruit"),
    "bohun": ("보훈의료공단", "https://www.bohun.or.kr/main/na/ntt/selectNttList.do?bbsId=1158&mi=37030&rcrut=medical"),
    "nmc": ("국립중앙의료원", "https://www.nmc.or.kr/nmc/board/B0000007/"),
    "kuh": ("건국대병원", "https://www.kuh.ac.kr/recruit/apply/noticeList.do"),
    "kumc": ("고려대의료원", "https://kumc.recruiter.co.kr/career/home"),
    "nursenet": ("널스넷", "https://nursenet.co.kr/jobs"),
    "smc": ("서울의료원", "https://smc.recruiter.co.kr/career/home"),
    "incruit": ("인크루트", "https://job.incruit.com/"),
}


def registry(spark: SparkSession) -> DataFrame:
    """(source_id, name, url, format, mode): a small dimension table; mode is auto, bridge for imports, link for what is only linked to."""
    modes = {"import": "bridge", "link": "link"}
    rows = [(s, *ADDRESSES[s], f, modes.get(f, "auto")) for f, names in SOURCES.items() for s in names.split()]
    return spark.createDataFrame(rows, "source_id string, name string, url string, format string, mode string")


def with_source(df: DataFrame, *, name: Column | str = "source") -> DataFrame:
    """df with source_id, source_url and source_mode by the source's name; an unknown one is its name in lower case, linked to, without an address."""
    r = registry(df.sparkSession).select(F.col("name").alias("_name"), F.col("source_id").alias("_id"), F.col("url").alias("source_url"), F.col("mode").alias("_mode"))
    given = F.col(name) if isinstance(name, str) else name
    j = df.join(F.broadcast(r), given == F.col("_name"), "left")  # forty rows
    return j.withColumns({"source_id": F.coalesce("_id", F.lower(given)), "source_mode": F.coalesce("_mode", F.lit("link"))}).drop("_name", "_id", "_mode")
