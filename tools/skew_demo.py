"""Hot-key demonstration: one (ip, hour, shop) key and one order id carry a
third of all events.  Runs the journey numbering and last touch both ways
(touchline operators vs the plain window forms), writes Spark's event log to
a scratch folder and prints, per job, the largest share of shuffle records
any single task read.  Usage: python tools/skew_demo.py [sf_dir]"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from touchline.operators import attribution as att
    from touchline.session import get_session
    from test_skew import skewed_events

    logdir = tempfile.mkdtemp(prefix="tl-eventlog-", dir="/tmp")
    spark = get_session("local[8]", app="skew-demo", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                               "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    ev = skewed_events(spark, sf_dir).cache()
    ev.count()

    def run(group: str, df) -> None:
        sc.setJobGroup(group, group)
        df.write.format("noop").mode("overwrite").save()

    run("journey steps: range buckets", att.touch_journey(ev, ordered=False, n_buckets=16))
    pairs = att.journey(ev, att.KEYS_NO_SHOP)
    w = Window.partitionBy("order_id").orderBy("t_ts", "t_event_id", "o_event_id")
    run("journey steps: plain window", pairs.withColumn("step", F.row_number().over(w)))
    run("last touch: aggregates", att.last_touch(ev, 90))
    j = att.journey(ev, att.KEYS_WITH_SHOP, 90)
    w2 = Window.partitionBy("order_id").orderBy(F.col("t_ts").desc(), "t_event_id", "o_event_id")
    run("last touch: pairs + window", j.withColumn("rn", F.row_number().over(w2)).filter("rn = 1"))
    # rows leaving the join: the aggregate form joins order events to one best
    # touch per key; the plain form joins them to every touch of the key
    join_rows_agg = att.order_events(ev).count()
    join_rows_pairs = j.count()
    spark.stop()

    stage_group, task_records = {}, defaultdict(list)
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for s in e.get("Stage IDs", []):
                        stage_group[s] = g
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    task_records[e["Stage ID"]].append(r)
    worst = defaultdict(lambda: (0.0, 0, 0))
    for s, recs in task_records.items():
        g = stage_group.get(s)
        tot = sum(recs)
        if not g or tot == 0:
            continue
        share = max(recs) / tot
        if max(recs) > worst[g][1]:
            worst[g] = (share, max(recs), tot)
    print(f"{'job':32s} {'max task records':>17s} {'stage records':>14s} {'share':>6s}")
    for g, (share, mx, tot) in sorted(worst.items()):
        print(f"{g:32s} {mx:17d} {tot:14d} {share:6.1%}")
    print(f"last touch, rows out of the join: aggregates {join_rows_agg}, "
          f"pairs + window {join_rows_pairs}")
    print("event log:", logdir)


if __name__ == "__main__":
    main()
