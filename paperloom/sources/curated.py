"""Small tables that come with the engine: built-in directions, curated classics and institution aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import normalize_title

#: Built-in directions with their labels and their neighbours, nearest first.
DIRECTIONS = {
    "e2e": ("端到端自动驾驶", ("planning", "world_model", "perception", "prediction", "safety")),
    "planning": ("运动规划与控制", ("control", "prediction", "e2e", "racing", "world_model")),
    "world_model": ("驾驶世界模型", ("e2e", "rl_driving", "llm_driving", "prediction")),
    "llm_driving": ("大模型+驾驶", ("world_model", "e2e", "rl_driving", "safety")),
    "control": ("车辆控制", ("planning", "racing", "safety", "e2e")),
    "perception": ("BEV感知", ("e2e", "prediction", "world_model", "safety")),
    "prediction": ("轨迹预测", ("planning", "perception", "e2e", "world_model")),
    "rl_driving": ("强化学习驾驶", ("world_model", "planning", "e2e")),
    "racing": ("自动驾驶竞赛", ("planning", "control", "e2e")),
    "safety": ("安全验证", ("control", "e2e", "perception", "llm_driving")),
}
#: Curated classics (title, year, venue, kind, arXiv id, directions).
CLASSICS = (
    ("Attention Is All You Need", 2017, "NeurIPS 2017", "conference", "1706.03762", ("e2e", "world_model", "llm_driving")),
    ("End to End Learning for Self-Driving Cars", 2016, "arXiv technical report", "preprint", "1604.07316", ("e2e", "control")),
    ("VectorNet: Encoding HD Maps and Agent Dynamics From Vectorized Representation", 2020, "CVPR 2020", "conference", "2005.04259", ("prediction", "planning", "e2e")),
    ("Trajectron++: Dynamically-Feasible Trajectory Forecasting With Heterogeneous Data", 2020, "ECCV 2020", "conference", "2001.03093", ("prediction", "planning")),
    ("BEVFormer: Learning Bird's-Eye-View Representation from Multi-Camera Images via Spatiotemporal Transformers", 2022, "ECCV 2022", "conference", "2203.17270", ("perception", "e2e")),
    ("Planning-Oriented Autonomous Driving", 2023, "CVPR 2023", "conference", "2212.10156", ("e2e", "planning", "perception", "prediction")),
    ("World Models", 2018, "arXiv technical report", "preprint", "1803.10122", ("world_model", "rl_driving")),
    ("Learning by Cheating", 2019, "CoRL 2019", "conference", "1912.12294", ("e2e", "planning", "control", "safety")),
    ("ChauffeurNet: Learning to Drive by Imitating the Best and Synthesizing the Worst", 2019, "RSS 2019", "conference", "1812.03079", ("e2e", "planning", "control", "safety")),
)
#: Institution aliases (original, canonical English name, Chinese name).
ALIASES = (
    ("CASIA", "Institute of Automation, Chinese Academy of Sciences", "中国科学院自动化研究所"), ("Li Auto", "Li Auto", "理想汽车"), ("PCL", "Peng Cheng Laboratory", "鹏城实验室"),
    ("NUS", "National University of Singapore", "新加坡国立大学"), ("Tsinghua", "Tsinghua University", "清华大学"), ("CAS", "Chinese Academy of Sciences", "中国科学院"),
    ("MIT", "Massachusetts Institute of Technology", "麻省理工学院"), ("Stanford University", "Stanford University", "斯坦福大学"),
)


def bare_title(title: str) -> str:
    """normalize_title for a Python string."""
    return "".join(c for c in title.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789" or "一" <= c <= "鿿")[:300]


def is_classic(title: Column, titles: tuple[str, ...] = tuple(c[0] for c in CLASSICS)) -> Column:
    """Whether the normalised title is that of a curated classic."""
    return F.coalesce(normalize_title(title).isin([bare_title(t) for t in titles]), F.lit(False))


def directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, i) for i, (k, (label, _)) in enumerate(DIRECTIONS.items())], "direction string, label string, position int")


def neighbours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, i) for k, (_, near) in DIRECTIONS.items() for i, n in enumerate(near)], "direction string, neighbour string, position int")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES), "original string, canonical_en string, name_zh string")


def classics(spark: SparkSession) -> DataFrame:
    """The classics as records (one row each), with the directions they belong to."""
    rows = [(f"arxiv:{a}", t, "", y, f"{y}-01-01", v, 0, "", f"https://arxiv.org/pdf/{a}.pdf", a, ["Curated classics"], list(d)) for t, y, v, _, a, d in CLASSICS]
    return spark.createDataFrame(rows, "openalex_id string, title string, abstract string, year int, published_date string, venue string, citations long, authors string, pdf_url string, arxiv_id string, sources array<string>, directions array<string>")
