"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: A log in the shape of the published ones: paths of 3 to 5 letters, one bound id each, many stretches again.
LOG = [f'{path}\t{kind}.id="{i}"' for i in (3, 11, 17) for path, kind in (("NCOP", "N"), ("NCOS", "N"), ("RNCO", "C"), ("COPS", "C"), ("NCOP", "N"), ("POCN", "P"), ("SOC", "S"), ("COPOC", "P"))]
HEADLINE = ("scan_relation_op", "mp_src_constraint", "mp_dst_constraint", "mp_mid_constraint", "mp_unconstrained", "mp_palindrome_all_matches", "mp_plan_dense", "mp_plan_sparse", "mp_plan_mnc")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pathloom import catalogue
    from pathloom.session import EngineConfig, Session
    from pathloom.sources.tables import table_graph

    found, taken = catalogue.queries(), {}
    system = spark._jvm.java.lang.management.ManagementFactory.getOperatingSystemMXBean()
    cpu = lambda: system.getProcessCpuTime() / 1e9 + time.process_time()  # of the JVM, which does the work, and of Python
    used, a_query = {}, {}
    for name in ("scan_relation_op", "mp_plan_sparse"):  # starts the JVM's compilers and the file cache
        found[name](spark, SF_DIR).count()
    for name in HEADLINE:
        began, before = time.perf_counter(), cpu()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        taken[name], used[name] = round(time.perf_counter() - began, 3), round(cpu() - before, 3)
    for engine in ("dynp", "result", "intermediate", "subpath"):
        session = Session(table_graph(spark, SF_DIR), EngineConfig(engine=engine))
        began, before = time.perf_counter(), cpu()
        _, metrics = session.run_workload(LOG)
        taken[f"log_{engine}"], used[f"log_{engine}"] = round(time.perf_counter() - began, 3), round(cpu() - before, 3)
        a_query[f"log_{engine}"] = round(taken[f"log_{engine}"] / len(LOG), 3)
        session.close()
        session.graph.close()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "cpu_seconds": used, "seconds_a_query": a_query, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
