"""Commands: crawl, checkpoint, merge, split, vocabulary, score, filter-sitemap, plan, is-challenge.

    python -m versefold.cli split --input-dir in --output-dir out [--train-ratio 0.8 ...]
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.config import CHECKPOINT_SCHEMAS, DELAY, GENRES, JITTER, PAUSE, PAUSE_EVERY, PROGRESS_SCHEMA, RATIOS, REPORT_SCHEMA, SEED, SPLITS
from versefold.functions.text import filename_stem, is_access_challenge, normalize_target, stem_with_uid, tokenize_source, tokenize_target
from versefold.functions.urls import normalize_author
from versefold.operators import collect, discover, metrics, sets, split, vocab
from versefold.operators.ordering import dense_numbers, prefix, stem_names
from versefold.session import local_session, ship, stored
from versefold.sources import pages, pairs, sinks, state


def numbered(rows: DataFrame) -> DataFrame:
    """row_idx over all files, in the order of their names."""
    return dense_numbers(rows.withColumnRenamed("row_idx", "at"), F.col("genre"), [F.col("at")], "row_idx").drop("at")


def merge(spark: SparkSession, a: argparse.Namespace) -> dict:
    files = pairs.list_files(spark, a.input_dir, a.output)
    rows = pairs.read_pairs(spark, files, "merge")
    return {"files": len(files), "rows": sinks.export_csv(rows, a.output, ["genre", "row_idx"], ["vi", "cn"])}


def split_files(spark: SparkSession, a: argparse.Namespace) -> dict:
    ratios = split.checked_ratios((a.train_ratio, a.test_ratio, a.val_ratio))
    rows = stored(numbered(pairs.read_pairs(spark, pairs.list_files(spark, a.input_dir))), "clean")
    done = stored(split.final_order(split.split(rows, "genre", "row_idx", ratios, a.seed), "row_idx", a.seed), "split")
    out = {"clean": sinks.export_csv(rows, os.path.join(a.output_dir, f"{a.prefix}.clean.csv"), ["row_idx"], ["vi", "cn"])}
    for name in SPLITS:
        out[name] = sinks.export_csv(done.where(F.col("split") == name), os.path.join(a.output_dir, f"{a.prefix}.{name}.csv"), ["mix_key"], ["vi", "cn"])
    return out


def vocabulary(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = numbered(pairs.read_pairs(spark, [a.train], "train"))
    for side, tokens, specials in (("vi", tokenize_source, vocab.SOURCE_SPECIALS), ("cn", tokenize_target, vocab.TARGET_SPECIALS)):
        v = vocab.vocabulary(rows, tokens(F.col(side)), specials=specials)
        sinks.export_vocabulary(v, os.path.join(a.output_dir, f"vocab_{'vi' if side == 'vi' else 'han'}.json"), specials)
    return {"output": a.output_dir}


def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores of a file of predictions; with an output folder, also predictions.csv (with the scores
    of each row) and metrics.json there."""
    began = time.monotonic()
    rows = spark.read.csv(a.predictions, header=True, multiLine=True, escape='"').withColumn("row_idx", F.monotonically_increasing_id())
    rows = stored(prefix(rows, ["row_idx"], a.limit).na.fill(""), "score")
    if not rows.limit(1).count():
        raise ValueError(f"no rows in {a.predictions}")
    out = {"test_file": os.path.abspath(a.predictions)} | metrics.evaluation(rows, "cn_ref", "cn_pred")
    out["elapsed_seconds"] = time.monotonic() - began
    if a.output_dir:
        plain = rows.withColumns({"ref": normalize_target(F.col("cn_ref")), "pred": normalize_target(F.col("cn_pred"))})
        sinks.export_predictions(metrics.details(plain), os.path.join(a.output_dir, "predictions.csv"))
        sinks.write_whole(os.path.join(a.output_dir, "metrics.json"), iter([json.dumps(out, ensure_ascii=False, indent=2) + "\n"]))
    return out


def given_authors(spark: SparkSession, values: list[str], files: list[str]) -> DataFrame:
    """Authors from the command line and from files (blank lines and comments left out; a file that
    isn't there is looked for beside this module). A name that can't be one is an error with its
    file and line."""
    given = [("--author", 0, v) for v in values]
    for path in files:
        beside = os.path.join(os.path.dirname(os.path.abspath(__file__)), path)
        real = beside if not os.path.exists(path) and os.path.exists(beside) else path
        with open(real, encoding="utf-8") as f:
            given += [(real, k, line.strip()) for k, line in enumerate(f, 1) if line.strip() and not line.strip().startswith("#")]
    if not given:
        raise ValueError("give at least one author or an authors file")
    rows = spark.createDataFrame(given, "file string, line int, value string").withColumn("author", normalize_author(F.col("value")))
    if bad := rows.where("author is null").orderBy("file", "line").limit(1).collect():
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line']}: an author's name must not be blank")
    return rows.select("author").distinct()


def filter_sitemap(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Lines removed from each sitemap; also the numbers of files, lines and removed lines."""
    authors = given_authors(spark, a.author or [], a.authors_file or [])
    out, lines = {}, 0
    for path in pairs.list_files(spark, a.xml_dir, pattern="*.xml"):
        local = path.removeprefix("file:")
        marked = stored(sets.sitemap(sinks.read_lines(spark, local), authors, a.scope, tuple(a.host) if a.host else None), "sitemap")
        lines += marked.count()
        out[os.path.basename(local)] = sinks.rewrite_lines(marked, local, a.dry_run)
    return out | {"files": len(out), "lines": lines, "removed": sum(out.values())}


def pace_of(a: argparse.Namespace) -> pages.Pace:
    return pages.Pace(a.delay, a.jitter, a.pause_every, (a.pause_min, a.pause_max), a.retries, a.challenge_retries, (a.challenge_pause_min, a.challenge_pause_max))


def fetching(a: argparse.Namespace) -> Callable:
    """Makes makers of fetch functions, by how many requests were made before."""
    pace, cookies, timeout = pace_of(a), a.cookie_file, a.timeout
    return lambda done=0: lambda: pages.patient(pages.browser(cookies, timeout), pace, pages.challenged, done=done)


def collect_urls(spark: SparkSession, urls: DataFrame, a: argparse.Namespace, make: Callable, source: str) -> dict:
    """Fetch what is still open, write a file for each poem, and save the progress after every
    a.batch poems (one, unless told), so a run that stops goes on where it was. Stopping is an error
    after all that was fetched is saved."""
    path, folder = a.progress or os.path.join(a.output_dir, "progress.json"), os.path.join(a.output_dir, "poems")
    items = {r["url"]: r.asDict() for r in state.progress(spark, path, source, PROGRESS_SCHEMA).toLocalIterator()}
    frame = lambda: spark.createDataFrame([tuple(r.get(c) for c in state.PROGRESS_COLUMNS) for r in items.values()], state.PROGRESS_ROWS)
    there = sinks.existing_poems(spark, folder).withColumnRenamed("name", "path")
    todo = collect.to_fetch(urls, frame(), there, retry=a.retry_skipped, overwrite=a.overwrite, trust=a.trust_progress)
    left = [(r["url"], r["url_idx"]) for r in prefix(todo.orderBy("url_idx"), ["url_idx"], a.limit).toLocalIterator()]
    stopped = None
    for k in range(0, len(left), a.batch):
        part = spark.createDataFrame(left[k : k + a.batch], "url string, url_idx long")
        got = stored(pages.outcomes(part.orderBy("url_idx"), make(k)), "got")
        poems = stored(pages.poems(got.where("stopped is null")).join(part, "url"), "poems")
        before = frame().where(F.col("status").isin(*collect.DONE) & F.col("output").isNotNull()).select("url", F.col("output").alias("before"))
        good = poems.where("error is null").withColumn("stem", filename_stem(F.col("title_vi"), F.col("uid")))
        used = frame().where("output is not null").select(F.col("output").alias("stem"))
        named = stem_names(good, "stem", "uid", "url_idx", stem_with_uid, used).join(before, "url", "left")
        named = stored(named.withColumn("name", F.coalesce("before", "name")).join(sinks.existing_poems(spark, folder).withColumn("there", F.lit(True)), "name", "left"), "named")
        new = named if a.overwrite else named.where("there is null")
        rows = new.select("name", F.posexplode(F.arrays_zip(F.col("lines_vi").alias("vi"), F.col("lines_cn").alias("cn"))).alias("pos", "x")).select("name", "pos", "x.vi", "x.cn")
        sinks.write_poems(rows, folder, a.overwrite)
        status = F.when(F.col("there") & ~F.lit(a.overwrite), "existing").otherwise("written")
        done = named.select("url", status.alias("status"), F.col("name").alias("output"), "title_vi", F.size("lines_vi").cast("long").alias("sentence_pairs"), F.lit(None).cast("string").alias("error"))
        bad = poems.where("error is not null").select("url", F.lit("skipped").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("output", "string"), ("title_vi", "string"), ("sentence_pairs", "long"))), "error")
        items |= {r["url"]: r.asDict() for r in done.unionByName(bad).collect()}
        state.save_progress(path, source, PROGRESS_SCHEMA, items)
        if stopped := got.where("stopped is not null").select("stopped").first():
            break
    mine = stored(frame().join(urls.select("url"), "url", "left_semi"), "outcomes")
    report = collect.report(mine, urls.count())
    sinks.export_report(report, collect.skipped(mine), os.path.join(a.output_dir, "report.json"), REPORT_SCHEMA, source)
    if stopped:
        raise pages.FetchError(stopped[0])
    return report.first().asDict()


def checkpoint(spark: SparkSession, a: argparse.Namespace) -> dict:
    doc = state.checkpoint(spark, a.url_checkpoint, a.source, fatal=True)
    return collect_urls(spark, stored(state.checkpoint_urls(doc), "urls"), a, fetching(a), a.source)


def crawl(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Discover a genre's poems, or go on from the checkpoint, save it, and collect what is open."""
    genre, make = GENRES[a.genre], fetching(a)
    if not a.no_robots:
        pages.check_allowed(make()(), genre.search_url if genre.poem_type else a.start)
    path = os.path.join(a.output_dir, "poem_urls.json")
    if genre.poem_type is None:
        urls = discover.group_tree(spark, a.start, make())
    elif a.limit:
        urls = discover.limited(spark, genre, make(), a.limit)
    else:
        urls = discovered(spark, genre, make(), path, a.refresh)
    order = [F.col(c) for c in urls.columns if c != "url"][0]
    listed = dense_numbers(urls.select("url", order.alias("seq")), F.lit(0), [F.col("seq")], "url_idx").drop("seq")
    return collect_urls(spark, stored(listed, "urls"), a, make, genre.name)


def discovered(spark: SparkSession, genre, make: Callable, path: str, refresh: bool = False) -> DataFrame:
    """A genre's URLs: a complete checkpoint's of the same counts, or those of a discovery that goes
    on from it. What has been found is saved also if it stops; an incomplete one is an error."""
    doc = None if refresh else state.checkpoint(spark, path, genre.name)
    if doc is not None:
        row = doc.select("complete", "age_partition_counts", "schema_version").first()
        if row["complete"] and (row["age_partition_counts"] or {}) == genre.ages and row["schema_version"] == CHECKPOINT_SCHEMAS[-1]:
            return state.checkpoint_urls(doc).select("url", "url_idx")
    d = discover.Discovery(spark, genre, make)
    if doc is not None:
        d.resume(stored(doc, "checkpoint"))
    try:
        urls = d.shallow() if genre.mode == "shallow" else d.country_age()
    except Exception:
        d.save(path, genre.name)
        raise
    if not d.save(path, genre.name):
        raise discover.DiscoveryError(f"{genre.name}: the discovery isn't complete")
    return urls


def plan(spark: SparkSession, a: argparse.Namespace) -> dict:
    genre = GENRES[a.genre]
    counts = spark.createDataFrame([(c, age, n) for c, ages in genre.ages.items() for age, n in ages.items()], "country string, age string, results long")
    return collect.totals(counts).first().asDict()


def challenge(spark: SparkSession, a: argparse.Namespace) -> dict:
    page = spark.read.text(a.page, wholetext=True)
    return {"challenge": page.select(is_access_challenge(F.col("value"))).first()[0]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="versefold", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run: Callable, *args: tuple) -> None:
        p = sub.add_parser(name)
        for flag, options in args:
            p.add_argument(flag, **options)
        p.set_defaults(run=run)

    need, many = {"required": True}, {"action": "append"}
    command("merge", merge, ("--input-dir", need), ("--output", need))
    command("split", split_files, ("--input-dir", need), ("--output-dir", need), ("--prefix", {"default": "poem"}), ("--seed", {"type": int, "default": SEED}), *((f"--{n}-ratio", {"type": float, "default": r}) for n, r in zip(SPLITS, RATIOS, strict=True)))
    command("vocabulary", vocabulary, ("--train", need), ("--output-dir", need))
    command("score", score, ("--predictions", need), ("--limit", {"type": bounded(int, 1)}), ("--output-dir", {}))
    command("filter-sitemap", filter_sitemap, ("--xml-dir", need), ("--author", many), ("--authors-file", many), ("--host", many), ("--scope", {"choices": ("poem", "all"), "default": "poem"}), ("--dry-run", {"action": "store_true"}))
    flag, at_least = {"action": "store_true"}, lambda kind, low, strict=False: {"type": bounded(kind, low, strict)}
    pace = [("--delay", at_least(float, 0) | {"default": DELAY}), ("--jitter", at_least(float, 0) | {"default": JITTER}), ("--pause-every", at_least(int, 0) | {"default": PAUSE_EVERY}), ("--pause-min", at_least(float, 0) | {"default": PAUSE[0]}), ("--pause-max", at_least(float, 0) | {"default": PAUSE[1]})]
    pace += [("--retries", at_least(int, 0) | {"default": 4}), ("--timeout", at_least(float, 0, True) | {"default": 30.0}), ("--challenge-retries", at_least(int, 0) | {"default": 0}), ("--challenge-pause-min", at_least(float, 0) | {"default": 0.0}), ("--challenge-pause-max", at_least(float, 0) | {"default": 0.0}), ("--cookie-file", {})]
    pace += [("--limit", at_least(int, 0)), ("--batch", at_least(int, 1) | {"default": 1}), ("--progress", {}), ("--overwrite", flag), ("--retry-skipped", flag), ("--trust-progress", flag)]
    command("checkpoint", checkpoint, ("--url-checkpoint", need), ("--source", need), ("--output-dir", need), *pace)
    command("crawl", crawl, ("--genre", {"choices": sorted(GENRES), "required": True}), ("--output-dir", need), ("--start", {}), ("--refresh", flag), ("--no-robots", flag), *pace)
    command("plan", plan, ("--genre", {"choices": sorted(GENRES), "required": True}))
    command("is-challenge", challenge, ("--page", need))
    return top


def bounded(kind: type, low: float, strict: bool = False) -> Callable[[str], float]:
    """An argument's type: numbers from low on, or above it."""

    def number(text: str):
        value = kind(text)
        if value < low or strict and value == low:
            raise argparse.ArgumentTypeError(f"must be {'above' if strict else 'at least'} {low}")
        return value

    number.__name__ = kind.__name__
    return number


def checked(top: argparse.ArgumentParser, argv: list[str] | None) -> argparse.Namespace:
    """Arguments whose bounds hold together."""
    a = top.parse_args(argv)
    for name in ("pause", "challenge_pause"):
        if getattr(a, f"{name}_max", 0) < getattr(a, f"{name}_min", 0):
            top.error(f"--{name.replace('_', '-')}-max must be at least its min")
    if getattr(a, "genre", None) and hasattr(a, "start") and GENRES[a.genre].poem_type is None and not a.start:
        top.error(f"--genre {a.genre} needs --start")
    return a


def main(argv: list[str] | None = None) -> None:
    a = checked(parser(), argv)
    for k, v in a.run(ship(local_session()), a).items():
        print(f"{k}: {v}")


if __name__ == "__main__":
    main()
