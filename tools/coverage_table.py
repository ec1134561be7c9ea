"""Print which registered query covers which inventory id (see README)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseloom.catalog import load  # noqa: E402

found: dict[str, list[str]] = {}
for name, entry in load().items():
    for sid in entry.survey:
        found.setdefault(sid, []).append(f"`{name}`" + ("" if entry.sql else " (rows)"))
sizes = {"A": 9, "B": 7, "C": 9, "D": 17, "E": 11, "F": 9, "G": 16, "H": 11, "J": 21, "K": 23}
print("| Inventory id | Queries |\n| --- | --- |")
for letter, size in sizes.items():
    for i in range(1, size + 1):
        sid = f"{letter}{i}"
        print(f"| {sid} | {', '.join(found.get(sid, ['—']))} |")
