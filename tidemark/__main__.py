"""get, set, delete and scan from a shell: python -m tidemark --data-dir DIR get KEY"""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from tidemark.store import CACHED, FOLLOWER, STRONG, Database


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--data-dir", help="folder of the store; without it the data go with the command")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, names in (("get", ["key"]), ("set", ["key", "value"]), ("delete", ["key"]), ("scan", ["start", "end"])):
        command = commands.add_parser(name)
        for n in names:
            command.add_argument(n)
        if name in ("get", "scan"):
            command.add_argument("--consistency", choices=(STRONG, FOLLOWER, CACHED), default=STRONG)
            command.add_argument("--wait", type=float, default=0.0, help="seconds to resolve locks and wait for them")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    db = Database(spark, a.data_dir or tempfile.mkdtemp(prefix="tidemark-"))
    if a.command == "get":
        value = db.get(a.key.encode(), consistency=a.consistency, wait=a.wait)
        if value is None:
            print("Key not found")
            return 1
        print(value.decode())
    elif a.command == "scan":
        for row in db.scan(a.start.encode(), a.end.encode(), consistency=a.consistency, wait=a.wait).toLocalIterator():
            print(f"{bytes(row.key).decode()}: {bytes(row.value).decode()}")
    else:
        db.set(a.key.encode(), a.value.encode()) if a.command == "set" else db.delete(a.key.encode())
        print("OK")
    return 0


if __name__ == "__main__":
    sys.exit(main())
