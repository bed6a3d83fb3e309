"""The corpus table: one row a repository record, from the records, their files, page texts and stated objectives; its checks and its report.

Inputs (one row a record or less): records (uuid, handle, program, metadata map<string, array<string>>), files (uuid, status, sha256), texts
(uuid, status, text_pages, ocr_pages), objectives (uuid, status, general, specific, flags). Joins are left joins on the record, so a record
has one row whatever it lacks; inputs that contradict each other stop the build with counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import metadata as M
from corpuslens.functions import records as R
from corpuslens.functions.text import fold_key
from corpuslens.operators import profile
from corpuslens.operators.guards import require
from corpuslens.operators.profile import completeness

ON_DISK = ("downloaded", "verified")


@dataclass(frozen=True)
class Settings:
    """Metadata keys, the type of a thesis, the day of the snapshot, programs by key, and resolvers of addresses."""

    thesis_type: str
    snapshot_day: str
    programs: Mapping[str, str]
    resolver: str = "https://hdl.handle.net/"
    pages: str = "https://example.org/items/"
    keys: Mapping[str, str] | None = None

    def key(self, name: str) -> str:
        return (self.keys or KEYS)[name]


#: Metadata keys by what they hold; a repository's own go into the settings.
KEYS = {"type": "type", "title": "title", "abstract": "abstract", "issued": "issued", "added": "added", "keyword": "keyword", "subject": "subject", "language": "language", "rights": "rights", "embargo": "embargo"}


def wrong_files(records: DataFrame, files: DataFrame, declared: DataFrame) -> DataFrame:
    """uuid, owner: records declared (handle, owner_handle) to carry the file of another. Both must be known, and the files equal by digest."""
    by_handle = records.filter("handle is not null").select("handle", "uuid").join(files.select("uuid", "status", "sha256"), "uuid", "left")
    mine = by_handle.select("handle", F.col("uuid").alias("uuid"), F.col("sha256").alias("own"), F.col("status"))
    theirs = by_handle.select(F.col("handle").alias("owner_handle"), F.col("uuid").alias("owner"), F.col("sha256").alias("other"))
    found = declared.join(mine, "handle", "left").join(theirs, "owner_handle", "left")
    checked = require(found, {"both handles are known": F.col("uuid").isNotNull() & F.col("owner").isNotNull(), "the file is a copy of the owner's": F.col("status").isin(*ON_DISK) & (F.col("own") == F.col("other"))})
    return checked.select("uuid", "owner_handle")


def duplicates(theses: DataFrame, settings: Settings) -> DataFrame:
    """uuid, duplicate_of: theses of one folded title and abstract, of which the first added stays, ties to the smaller uuid."""
    key = F.sha2(F.concat_ws("\n", fold_key(_first(settings, "title")), fold_key(_first(settings, "abstract"))), 256)
    rows = theses.select(F.col("uuid"), key.alias("key"), _first(settings, "added").alias("added")).filter("key is not null")
    return profile.canonical(rows, ["key"], ["added"], "uuid")


def _first(settings: Settings, name: str) -> Column:
    return M.first(F.col("metadata")[settings.key(name)])


def _values(settings: Settings, name: str) -> Column:
    return F.coalesce(M.values(F.col("metadata")[settings.key(name)]), F.array().cast("array<string>"))


def build(records: DataFrame, files: DataFrame, texts: DataFrame, objectives: DataFrame, declared: DataFrame, settings: Settings) -> DataFrame:
    """The corpus table, one row a record."""
    program = F.create_map(*(x for k, v in settings.programs.items() for x in (F.lit(k), F.lit(v))))
    kinds = records.withColumn("document_type", R.document_type(F.col("metadata")[settings.key("type")], settings.thesis_type))
    kept = duplicates(kinds.filter("document_type = 'thesis'"), settings)
    joined = (
        kinds.join(files.select("uuid", F.col("status").alias("file_status"), "sha256"), "uuid", "left")
        .join(texts.select("uuid", F.col("status").alias("text_status"), "text_pages", "ocr_pages"), "uuid", "left")
        .join(objectives.select("uuid", F.col("status").alias("found"), "general", "specific", "flags"), "uuid", "left")
        .join(wrong_files(records, files, declared), "uuid", "left")
        .join(kept, "uuid", "left")
    )
    on_disk = F.coalesce(F.col("file_status").isin(*ON_DISK), F.lit(False))
    own = on_disk & F.col("owner_handle").isNull()
    checked = require(
        joined,
        {
            "a file on disk has its objectives row": ~own | F.col("found").isNotNull(),
            "a file on disk has its page texts": ~own | F.coalesce(F.col("text_status") == "ok", F.lit(False)),
            "an objectives row has its file on disk": F.col("found").isNull() | on_disk,
            "the program is declared": F.col("program").isin(*settings.programs),
        },
    )
    issued, day = _first(settings, "issued"), M.partial_day(_first(settings, "issued"))
    stated = F.when(own, R.joined_parts(F.col("general"), F.col("specific")))
    reason = F.when(F.col("document_type") != "thesis", "non_thesis_type").when(F.col("duplicate_of").isNotNull(), "duplicate")
    notes = F.when(F.col("owner_handle").isNotNull(), F.array(F.concat(F.lit("the file belongs to "), "owner_handle"))).when(own, F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("objectives: "), f)))
    return checked.select(
        "uuid",
        M.short_code("uuid", "D-").alias("doc_code"),
        R.item_url(F.col("handle"), F.col("uuid"), settings.resolver, settings.pages).alias("url"),
        "handle",
        "document_type",
        _first(settings, "title").alias("title"),
        _first(settings, "abstract").alias("abstract"),
        stated.alias("objectives"),
        F.when(own, F.col("found")).otherwise("no_pdf").alias("objectives_status"),
        "program",
        program[F.col("program")].alias("program_name"),
        issued.alias("issue_date"),
        F.year(day).alias("issue_year"),
        F.coalesce(day > F.lit(settings.snapshot_day).cast("date"), F.lit(False)).alias("issued_after_snapshot"),
        _values(settings, "keyword").alias("keywords"),
        F.transform(_values(settings, "subject"), lambda x: M.after_last(x)).alias("subject_codes"),
        _first(settings, "language").alias("language"),
        R.access_class(F.col("metadata")[settings.key("rights")]).alias("rights"),
        M.partial_day(_first(settings, "embargo")).alias("embargo_end"),
        F.coalesce("file_status", F.lit("not_attempted")).alias("pdf_status"),
        F.when(on_disk, F.col("sha256")).alias("pdf_sha256"),
        F.when(own, R.source_format(F.col("text_pages"), F.col("ocr_pages"))).otherwise("none").alias("source_format"),
        F.when(stated.isNotNull(), "title_abstract_objectives").otherwise("title_abstract").alias("section_source"),
        reason.isNull().alias("include"),
        reason.alias("exclusion_reason"),
        "duplicate_of",
        F.coalesce(notes, F.array().cast("array<string>")).alias("notes"),
    )


def usable(corpus: DataFrame) -> DataFrame:
    """Included theses that have an abstract."""
    return corpus.filter("include and abstract is not null")


def counts(corpus: DataFrame) -> DataFrame:
    """The counts that a release declares, as rows (name, n)."""
    inc = F.col("include")
    named = {
        "records": F.lit(True),
        "included": inc,
        "duplicates": F.col("exclusion_reason") == "duplicate",
        "non_thesis": F.col("exclusion_reason") == "non_thesis_type",
        "objectives_extracted": inc & (F.col("objectives_status") == "extracted"),
        "metadata_only": inc & (F.col("section_source") == "title_abstract"),
    }
    return corpus.agg(F.array(*(F.struct(F.lit(k).alias("name"), F.count_if(c).alias("n")) for k, c in named.items())).alias("c")).select(F.inline("c"))


def check(corpus: DataFrame, expected: Mapping[str, int]) -> dict[str, int]:
    """The counts, once codes are unique, no used file serves two included theses, and each count is as declared; all faults at once."""
    problems = []
    repeated = corpus.groupBy("doc_code").count().filter("count > 1").count()
    if repeated:
        problems.append(f"{repeated} codes are repeated")
    used = corpus.filter("include and objectives_status in ('extracted', 'not_found')").groupBy("pdf_sha256").count().filter("count > 1").count()
    if used:
        problems.append(f"{used} files serve several included theses")
    found = {r.name: r.n for r in counts(corpus).collect()}
    problems += [f"{k} is {found.get(k)}, {n} is declared" for k, n in expected.items() if found.get(k) != n]
    if problems:
        raise ValueError("; ".join(problems))
    return found


def duplicate_report(corpus: DataFrame) -> DataFrame:
    """Each duplicate beside the record that stays: whether it has the smaller uuid, the same file, the same objectives (null if one has none)."""
    kept = corpus.select(F.col("uuid").alias("duplicate_of"), F.col("handle").alias("kept"), F.col("pdf_sha256").alias("kept_pdf"), F.col("objectives").alias("kept_objectives"))
    pairs = corpus.filter("duplicate_of is not null").join(kept, "duplicate_of")
    return pairs.select("kept", F.col("handle").alias("duplicate"), (F.col("duplicate_of") < F.col("uuid")).alias("kept_is_smaller"), F.coalesce(F.col("kept_pdf") == F.col("pdf_sha256"), F.lit(False)).alias("same_pdf"), (F.col("kept_objectives") == F.col("objectives")).alias("objectives_equal"))


#: Columns whose values the quality report counts, and those whose presence it counts.
COUNTED = ("document_type", "objectives_status", "pdf_status", "source_format", "section_source", "rights", "language")
PRESENT = ("title", "abstract", "objectives", "issue_year", "language", "pdf_sha256")


def quality_report(corpus: DataFrame, counted: Sequence[str] = COUNTED, present: Sequence[str] = PRESENT, texts: Sequence[str] = ("title", "abstract", "objectives")) -> DataFrame:
    """The report as rows (section, name, value, n): inclusion, counts of categories over the included, notes, presence, and lengths of texts."""
    inc = corpus.filter("include")

    def tally(rows: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return rows.groupBy(F.lit(section).alias("section"), name.alias("name"), F.coalesce(value.cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").cast("double").alias("n"))

    parts = [
        tally(corpus, "counts", F.lit("include"), F.when(F.col("include"), "included").otherwise("excluded")),
        tally(corpus.filter("not include"), "counts", F.lit("exclusion_reason"), F.col("exclusion_reason")),
        tally(inc, "counts", F.lit("program"), F.col("program")),
        tally(inc, "counts", F.lit("year"), F.col("issue_year")),
        tally(inc.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in counted))).alias("x")), "counts", F.col("x.name"), F.col("x.value")),
        tally(inc.select(F.explode("notes").alias("note")), "notes", F.lit("note"), F.regexp_replace("note", r"(belongs to) .*$", "$1")),
        tally(inc.filter("issued_after_snapshot"), "future_dated", F.lit("handle"), F.col("handle")),
        completeness(inc, present).select(F.lit("completeness").alias("section"), F.col("column").alias("name"), F.lit("present").alias("value"), F.col("present").cast("double").alias("n")),
    ]
    lengths = inc.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.length(c).alias("chars")) for c in texts)))).filter("chars is not null")
    stats = lengths.groupBy("name").agg(F.count("*").cast("double").alias("n"), F.min("chars").cast("double").alias("least"), F.percentile("chars", F.lit(0.5)).alias("median"), F.max("chars").cast("double").alias("most"))
    unpivoted = stats.select(F.lit("lengths").alias("section"), "name", F.inline(F.array(*(F.struct(F.lit(k).alias("value"), F.col(k).alias("n")) for k in ("n", "least", "median", "most")))))
    out = parts[0]
    for p in [*parts[1:], unpivoted]:
        out = out.unionByName(p)
    return out


def date_quality(records: DataFrame, settings: Settings) -> DataFrame:
    """How many records are dated after the snapshot, and how many dates can't be read."""
    issued, day = _first(settings, "issued"), M.partial_day(_first(settings, "issued"))
    return records.agg(F.count_if(day > F.lit(settings.snapshot_day).cast("date")).alias("future"), F.count_if(issued.isNotNull() & day.isNull()).alias("unparsed"))


def other_items(corpus: DataFrame) -> DataFrame:
    """Types, programs and years of the records that are no theses: kind, value, n."""
    rest = corpus.filter("document_type <> 'thesis'")
    one = lambda kind, col: rest.groupBy(F.lit(kind).alias("kind"), F.coalesce(F.col(col).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))
    return one("type", "document_type").unionByName(one("program", "program")).unionByName(one("year", "issue_year"))


def parity(theses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections (doc, section) that only one of two tables has: doc, section, side. Both must have the same, so it is empty when all is well."""
    a = theses.select("doc", "section").distinct().withColumn("left", F.lit(True))
    b = chunks.select("doc", "section").distinct().withColumn("right", F.lit(True))
    found = a.join(b, ["doc", "section"], "full").filter("left is null or right is null")
    return found.select("doc", "section", F.when(F.col("left").isNull(), "chunks").otherwise("theses").alias("side"))


def as_row(title: str, abstract: str, objectives: str | None, template: DataFrame) -> DataFrame:
    """A proposal as a row of the corpus table, so that it goes the corpus's own way: columns that it can't have are null."""
    given = {"uuid": "proposal", "doc_code": "proposal", "title": title, "abstract": abstract, "objectives": objectives, "section_source": "title_abstract_objectives" if objectives else "title_abstract", "include": True}
    spark = template.sparkSession
    return spark.range(1).select(*(F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in template.schema))
