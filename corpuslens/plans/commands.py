"""The stages of a study as commands: each reads published tables of earlier stages, makes its own, guards what leaves the machine, and publishes them
with a manifest. ``--dry-run`` verifies the inputs and says what would be done, and writes nothing.

A stage's folder is <home>/<snapshot>/<stage>. One that is published is not run again. Libraries that read, encode or fetch are ports, given
by name.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import cleaning, records, text
from corpuslens.operators import comparison, corpus, objectives, pages, pairs, search, terms
from corpuslens.operators.guards import leaks, refuse_leaks, require
from corpuslens.plans import expert, gap_run, temporal
from corpuslens.sources import strict, topic_lists

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """What a stage is given: where, settings by name, ports by name, and the strings that may not leave (needle)."""

    spark: SparkSession
    home: str
    snapshot: str
    settings: Mapping[str, object] = field(default_factory=dict)
    ports: Mapping[str, Callable] = field(default_factory=dict)
    sensitive: DataFrame | None = None

    def folder(self, stage: str) -> str:
        return f"{self.home}/{self.snapshot}/{stage}"

    def port(self, name: str) -> Callable:
        if name not in self.ports:
            raise LookupError(f"the port {name} is not given")
        return self.ports[name]


@dataclass(frozen=True)
class Stage:
    """Its name, the tables that it needs of other stages, what it makes, and which of its tables are guarded."""

    name: str
    needs: Mapping[str, Sequence[str]]
    make: Callable[[Job, Tables], tuple[Tables, Mapping[str, object]]]
    guarded: Sequence[str] = ()


STAGES: dict[str, Stage] = {}


def stage(needs: Mapping[str, Sequence[str]] | None = None, guarded: Sequence[str] = ()):
    def add(f: Callable[[Job, Tables], tuple[Tables, Mapping[str, object]]]):
        STAGES[f.__name__] = Stage(f.__name__, needs or {}, f, guarded)
        return f

    return add


def published(job: Job, name: str) -> bool:
    try:
        strict.manifest(job.spark, job.folder(name))
    except FileNotFoundError:
        return False
    return True


def written_text(df: DataFrame) -> DataFrame:
    """id, text: the rows as the JSON lines that they are written as, so that the guard sees just these."""
    return df.select(F.monotonically_increasing_id().alias("id"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("text"))


def guard(job: Job, name: str, df: DataFrame) -> None:
    """Refuses a table that holds a sensitive string; says how many rows do, never which string."""
    if job.sensitive is not None:
        refuse_leaks(leaks(written_text(df), "id", "text", job.sensitive), f"rows of {name}")


def run(name: str, job: Job, dry_run: bool = False) -> dict[str, object]:
    """Runs a stage, or says what it would read; the answer holds counts only."""
    s = STAGES[name]
    if published(job, name):
        raise FileExistsError(f"{name} of {job.snapshot} is published")
    manifests = {n: strict.manifest(job.spark, job.folder(n)) for n in s.needs}
    inputs = {t: strict.read_verified(job.spark, job.folder(n), t) for n, ts in s.needs.items() for t in ts}
    read = {f"{n}.{t}": manifests[n]["tables"][t] for n, ts in s.needs.items() for t in ts}
    if dry_run:
        return {"stage": name, "dry_run": True, "inputs": {k: v["rows"] for k, v in read.items()}}
    tables, facts = s.make(job, inputs)
    for t in s.guarded:
        guard(job, t, tables[t])
    done = strict.publish(job.spark, job.folder(name), tables, {"snapshot": job.snapshot, "stage": name, "inputs": read, **facts})
    return {"stage": name, "rows": {k: v["rows"] for k, v in done["tables"].items()}, **facts}


@stage()
def harvest(job: Job, given: Tables):
    """Records of all programs by the port ``list`` (program -> (records frame of strict.RECORD, reported total)); totals must reconcile."""
    out, totals = None, {}
    for program in job.settings["programs"]:
        found, reported = job.port("list")(job.spark, program)
        n = found.count()
        if n != reported:
            raise ValueError(f"{program}: {n} records, {reported} reported")
        totals[program] = n
        out = found if out is None else out.unionByName(found)
    once = require(out.groupBy("uuid").agg(F.countDistinct("program_key").alias("programs"), F.count("*").alias("n")), {"a record is in one program, once": F.col("n") == 1})
    safe = out.join(once.select("uuid"), "uuid").withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.endswith(".dni")))
    return {"records": safe}, {"totals": totals}


@stage({"harvest": ["records"]})
def download(job: Job, given: Tables):
    """Files of the records by the port ``fetch`` (records -> log of uuid, status, sha256)."""
    log = job.port("fetch")(given["records"].select("uuid"))
    return {"files": log.select("uuid", "status", "sha256")}, {}


@stage({"download": ["files"]})
def extraction(job: Job, given: Tables):
    """Page texts by the port ``pages`` (files on disk -> doc, page, text, source) without their running lines; and a row a document."""
    read = job.port("pages")(given["files"].filter(F.col("status").isin(*corpus.ON_DISK))).select("doc", "page", "text", "source")
    clean = pages.remove_running_lines(read)
    per = clean.join(read.select("doc", "page", "source"), ["doc", "page"]).groupBy(F.col("doc").alias("uuid"))
    texts = per.agg(F.lit("ok").alias("status"), F.count_if(F.col("source") == "text_layer").alias("text_pages"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"))
    return {"pages": clean.join(read.select("doc", "page", "source"), ["doc", "page"]).select("doc", "page", "text", "source"), "texts": texts}, {}


@stage({"extraction": ["pages"]})
def stated_objectives(job: Job, given: Tables):
    found = objectives.locate_all(given["pages"])
    return {"objectives": found.select(F.col("doc").alias("uuid"), "status", "general", "specific", "flags"), "summary": objectives.summary(found)}, {}


@stage({"harvest": ["records"], "download": ["files"], "extraction": ["texts"], "stated_objectives": ["objectives"]}, guarded=["report"])
def corpus_table(job: Job, given: Tables):
    """The corpus table, once its counts are the declared ones, and its quality report."""
    flat = given["records"].select("uuid", "handle", F.col("program_key").alias("program"), F.transform_values("metadata", lambda _, v: F.transform(v, lambda x: x["value"])).alias("metadata"))
    declared = job.spark.createDataFrame(list(job.settings.get("wrong_files", [])), "handle string, owner_handle string")
    built = corpus.build(flat, given["files"], given["texts"], given["objectives"], declared, job.settings["corpus"])
    counts = corpus.check(built, job.settings.get("expected", {}))
    return {"corpus": built, "report": corpus.quality_report(built), "duplicates": corpus.duplicate_report(built)}, {"counts": counts}


@stage({"corpus_table": ["corpus"]})
def chunk_table(job: Job, given: Tables):
    limit, count = int(job.settings.get("token_limit", 128)), job.ports.get("tokens", text.word_tokens)
    rows = corpus.usable(given["corpus"]).withColumn("doc_id", F.conv(F.substring("doc_code", 3, 8), 16, 10).cast("bigint"))
    sections = records.sections(rows, "doc_id", ["title", "abstract", "objectives"]).withColumn("text", text.light_clean(F.col("text")))
    cut = text.chunks(sections, limit, count)
    faults = text.check_chunks(cut, sections, limit).first()
    if faults.over or faults.lost:
        raise ValueError(f"{faults.over} sections have a chunk over the limit, {faults.lost} lose text")
    return {"sections": sections, "chunks": cut}, {"token_limit": limit, "longest_chunk": cut.agg(F.max("n_tokens")).first()[0] or 0}


@stage({"chunk_table": ["chunks"]})
def embeddings(job: Job, given: Tables):
    """Vectors of distinct chunk texts by the port ``encode`` (texts -> vectors), pooled by document; chunks that the index's model would cut are refused."""
    from corpuslens.sources.files import encode

    keyed = given["chunks"].withColumn("cache_key", strict.cache_key(F.lit(str(job.settings["model"])), F.lit(str(job.settings["revision"])), F.col("text")))
    if (given["chunks"].agg(F.max("n_tokens")).first()[0] or 0) > int(job.settings["model_limit"]):
        raise ValueError("the model would cut a chunk")
    vecs = encode(keyed.select("cache_key", "text"), job.port("encode"))
    chunked = keyed.join(vecs, "cache_key").select(F.col("doc_id").alias("doc"), "section", "vec")
    plain, means = terms.pool(chunked, "plain_mean"), terms.pool(chunked)
    same = terms.variant_agreement(means, plain, 0.99).first().asDict()
    return {"rows": means.select(F.col("doc").alias("id"), "vec")}, {"model": job.settings["model"], "revision": job.settings["revision"], "agreement": same}


@stage({"chunk_table": ["sections"]})
def term_weights(job: Job, given: Tables):
    """TF-IDF of the content words of sections, by document."""
    stop, domain = job.settings.get("stopwords", ()), job.settings.get("domain_stopwords", ())
    words = cleaning.content_words(F.col("text"), stop, domain, job.ports.get("lemmas"), light=False)
    rows = given["sections"].select(F.col("doc_id").alias("doc"), "section", words.alias("tokens"))
    vocab = terms.vocabulary(terms.ngrams(rows), rows, int(job.settings.get("min_df", 2)))
    return {"words": rows, "vocabulary": vocab, "weights": terms.section_mean(rows, vocab)}, {"lemmas": vocab.agg(cleaning.list_digest(F.collect_list("term"))).first()[0]}


@stage({"corpus_table": ["corpus"], "embeddings": ["rows"], "topic_maps": ["labels", "npmi"]}, guarded=["gaps"])
def gaps(job: Job, given: Tables):
    rows = corpus.usable(given["corpus"]).select(F.conv(F.substring("doc_code", 3, 8), 16, 10).cast("bigint").alias("id"), "program", F.col("issue_year").alias("year"))
    affinity = job.spark.createDataFrame(list(job.settings["affinity"]), "source string, target string, score int")
    s = job.settings.get("gaps", gap_run.Settings())
    got = gap_run.run(given["labels"], given["rows"], rows, given["npmi"], strict.symmetric(affinity, list(job.settings["programs"])), int(job.settings["reference_run"]), s)
    return {"cuts": got.cuts, "gaps": got.gaps, "members": got.members, "support": got.support, "sensitivity": got.sensitivity}, {"settings": gap_run.facts(s)}


@stage({"embeddings": ["rows"], "corpus_table": ["corpus"]})
def topic_maps(job: Job, given: Tables):
    """Labels of each seed by the port ``cluster`` ((rows, seed) -> id, label) and the coherence of their topics by the port ``coherence``."""
    out = None
    for k, seed in enumerate(job.settings["seeds"]):
        own = job.port("cluster")(given["rows"], seed).select(F.lit(k).alias("run"), F.lit(f"s{seed}").alias("run_id"), "id", "label")
        out = own if out is None else out.unionByName(own)
    return {"labels": out, "npmi": job.port("coherence")(out)}, {"seeds": list(job.settings["seeds"])}


@stage({"embeddings": ["rows"], "corpus_table": ["corpus"]}, guarded=["drawn"])
def pair_draw(job: Job, given: Tables):
    """The labeled set's pairs, drawn once."""
    programs = corpus.usable(given["corpus"]).select(F.conv(F.substring("doc_code", 3, 8), 16, 10).cast("bigint").alias("id"), "program")
    every = pairs.universe({"first": given["rows"], **{n: p(given["rows"]) for n, p in job.settings.get("representations", {}).items()}}, programs, list(job.settings["programs"]))
    drawn = pairs.draw(every, job.settings["plan"])
    return {"drawn": drawn, "ranges": pairs.ranges(drawn, every, list(job.settings["plan"].high))}, {"pairs": every.count()}


@stage({"pair_draw": ["drawn"]}, guarded=["calibration"])
def threshold(job: Job, given: Tables):
    """Thresholds and the comparison of two representations over the drawn pairs, labelled by the port ``labels`` (drawn -> pair id, two scores, label)."""
    first, second = job.settings["compare"]
    rows = job.port("labels")(given["drawn"])
    table, intervals, d = comparison.compare(rows, "pair_id", first, second, folds=int(job.settings.get("folds", 5)), resamples=int(job.settings.get("resamples", 1000)), seed=int(job.settings.get("seed", 42)))
    return {"calibration": table, "intervals": intervals}, {"verdict": d.verdict}


@stage({"embeddings": ["rows"], "corpus_table": ["corpus"], "term_weights": ["words", "vocabulary"], "topic_maps": ["labels"]}, guarded=["topics"])
def temporal_split(job: Job, given: Tables):
    meta = corpus.usable(given["corpus"]).select(F.conv(F.substring("doc_code", 3, 8), 16, 10).cast("bigint").alias("id"), "program", F.col("issue_year").alias("year"))
    m = temporal.fit(given["rows"], meta, given["words"], int(job.settings["split_year"]), lambda rows: job.port("cluster")(rows, job.settings["seeds"][0]), vocabulary=given["vocabulary"])
    late = temporal.assign_late(m)
    full = temporal.full_labels(given["labels"], f"s{job.settings['seeds'][0]}", given["rows"])
    sample = temporal.expert_sample(late, meta, int(job.settings["sample"]), int(job.settings["atypical"]), int(job.settings.get("floor", 0)), str(job.settings.get("seed", 42)))
    return {"topics": m.topics, "early_labels": m.labels, "late": late, "consistency": temporal.consistency(m, late, full), "sample": sample}, {}


@stage({"temporal_split": ["sample", "late", "early_labels", "topics"]}, guarded=["cases"])
def expert_cases(job: Job, given: Tables):
    joined = given["sample"].join(given["late"].select("id", "topic", "atypical"), "id")
    sizes = given["early_labels"].filter("label <> -1").groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("size"))
    cases = expert.assignments(joined, given["early_labels"], given["topics"], sizes, str(job.settings.get("seed", 42)), job.settings.get("case_sizes", expert.Sizes(2)))
    return {"cases": cases}, {}


@stage()
def topic_list(job: Job, given: Tables):
    """A public list of topics by the port ``get`` (url -> bytes), complete or nothing."""
    found = topic_lists.read(job.port("get"), str(job.settings["topics_url"]))
    return {"topics": topic_lists.table(job.spark, found)}, {"count": len(found)}


@stage({"embeddings": ["rows"], "topic_maps": ["labels"], "gaps": ["gaps", "support"]})
def query_tables(job: Job, given: Tables):
    """What queries read: vectors, the reference run's labels and its stable gaps."""
    reference = int(job.settings["reference_run"])
    labels = given["labels"].filter(F.col("run") == reference).select("id", "label")
    stable = given["gaps"].join(given["support"].filter("stable"), "gap_id", "left_semi")
    named = stable.select(F.row_number().over(search.W.orderBy("gap_id")).cast("bigint").alias("gap_no"), F.col("topics")[0].alias("first"), F.try_element_at("topics", F.lit(2)).alias("second"))
    return {"rows": given["rows"], "labels": labels, "gaps": named}, {k: job.settings[k] for k in ("model", "revision") if k in job.settings}


def main(argv: Sequence[str], spark: SparkSession, settings: Mapping[str, object], ports: Mapping[str, Callable], sensitive: DataFrame | None = None) -> int:
    """``stage [--home H] [--snapshot S] [--dry-run]``: one JSON line; 0 if done, 1 with the reason if refused."""
    parser = argparse.ArgumentParser(prog="corpuslens")
    parser.add_argument("stage", choices=sorted(STAGES))
    parser.add_argument("--home", required=True)
    parser.add_argument("--snapshot", required=True)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(list(argv))
    try:
        told = run(args.stage, Job(spark, args.home, args.snapshot, settings, ports, sensitive), args.dry_run)
    except (FileExistsError, FileNotFoundError, LookupError, ValueError) as refused:
        print(json.dumps({"stage": args.stage, "refused": str(refused)}))
        return 1
    print(json.dumps(told, default=str, sort_keys=True))
    return 0
