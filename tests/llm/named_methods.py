"""Figures of the named methods of problems 3 and 8 beside what is used in their place: python -m tests.llm.named_methods FOLDER."""

import os
import sys
import time

import psutil

from kvern.llm import overlaps, spans
from kvern.session import local_session, materialize, scratch, shared_dir
from kvern.sources.tables import table


def disk(spark) -> float:
    folder = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files) / 1e6


def seconds() -> float:
    me = psutil.Process()
    own = [me, *me.children(recursive=True)]
    total = 0.0
    for p in own:
        try:
            t = p.cpu_times()
            total += t.user + t.system + t.children_user + t.children_system
        except psutil.Error:
            pass
    return total


def measured(spark, name, make, truth):
    with scratch():
        began, cpu = time.time(), seconds()
        got = {tuple(r) for r in make().collect()}
        print(f"{name}: rows {len(got)}, true {len(truth)}, found {len(got & truth)}, recall {len(got & truth) / max(1, len(truth)):.4f}, precision {len(got & truth) / max(1, len(got)):.4f}, s {time.time() - began:.1f}, CPU s {seconds() - cpu:.1f}, written MB {disk(spark):.0f}", flush=True)


def main(folder: str) -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    labels, listed, manifest, documents = (table(spark, folder, n) for n in ("labels", "splittliste", "manifest", "documents"))
    member = materialize(overlaps.split_members(listed, manifest).select("doc", "splitt").distinct())
    trained, evaluated = member.where("splitt = 'train'").select("doc"), member.where("splitt <> 'train'").select("doc").distinct()
    boxes = lambda: materialize(overlaps.boxes(labels))
    near = lambda: overlaps.near_same(boxes(), evaluated, trained).select("doc_e", "doc_t")
    truth = {tuple(r) for r in near().collect()}
    measured(spark, "p3 in use", near, truth)
    for prefix in (1, 2, 3):
        sizes = boxes().groupBy("doc").count()
        some = lambda k: overlaps.suffix_array_pairs(boxes(), evaluated, trained, k)
        if prefix > 1:
            measured(spark, f"p3 suffix array, prefix {prefix}, any shared span", lambda: some(prefix).select("doc_e", "doc_t"), truth)
        measured(spark, f"p3 suffix array, prefix {prefix}, 60 % covered", lambda: some(prefix).join(sizes.withColumnRenamed("doc", "doc_e"), "doc_e").where("count >= 5 and covered >= 0.6 * count").select("doc_e", "doc_t"), truth)
    pairs = lambda: spans.shared_pairs(documents)
    truth = {tuple(r) for r in pairs().collect()}
    measured(spark, "p8 in use", pairs, truth)
    for bands, rows, least in ((20, 5, 0.8), (50, 2, 0.3), (60, 1, 0.1)):
        measured(spark, f"p8 paragraphs, {bands} bands of {rows}, Jaccard {least}", lambda: spans.paragraph_pairs(documents, bands, rows, least=least), truth)


if __name__ == "__main__":
    main(sys.argv[1])
