"""Plain Python for headline queries, one process, one table read by pyarrow: python tools/plain.py SF_DIR. Prints seconds by query.

Only as much as the query gives; the same rows as the Spark queries, so their times can be set side by side."""

import re
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows(d, name, *columns):
    return pq.read_table(f"{d}/{name}.parquet", columns=list(columns)).to_pylist()


def once(some, key, order="ingested_at"):
    out = {}
    for r in some:
        if r[key] not in out or r[order] < out[r[key]][order]:
            out[r[key]] = r
    return list(out.values())


def calls(d, *columns):
    return sorted(once(rows(d, "tool_results", "call_id", "ingested_at", "run_id", "step_idx", "call_idx", *columns), "call_id"), key=lambda r: (r["run_id"], r["step_idx"], r["call_idx"], r["call_id"]))


def turns(d, *columns):
    return sorted(once(rows(d, "turns", "turn_id", "ingested_at", "run_id", "step_idx", *columns), "turn_id"), key=lambda r: (r["run_id"], r["step_idx"], r["turn_id"]))


def runs(some):
    out = defaultdict(list)
    for r in some:
        out[r["run_id"]].append(r)
    return out


def p2_pack(d):
    from runloom.llm import pack_kernel as k

    sizes = [len(r["prompt_ids"] or ()) + len(r["response_ids"] or ()) for r in rows(d, "segments", "prompt_ids", "response_ids")]
    n = 0
    for r in rows(d, "pack_limits", "capacity"):
        cap, hist = r["capacity"], Counter()
        for s in sizes:
            hist[cap] += s // cap
            hist[s % cap] += 1
        n += sum(c * m for lengths, c, _ in k.pack({a: b for a, b in hist.items() if a > 0 and b > 0}, cap) for m in lengths.values())
    return n


def p3_found(d):
    from runloom.llm import run_kernel as k

    n = 0
    for some in runs(calls(d, "tool_name", "action", "status")).values():
        found = k.agglomerate([(r["tool_name"], r["status"]) for r in some], [(k.canonical(r["action"]), r["action"] or "") for r in some], [0] * len(some), [0] * len(some), k.SAME, None)
        n += sum(b > a for a, b in found)
    return n


def p5_found(d):
    kept, n = {}, 0
    for r in rows(d, "chat_events", "delivery_id", "message_id", "received_at"):
        m = (r["message_id"] or "").strip()
        if m:
            n += m in kept
            kept[m] = min(kept.get(m, (r["received_at"], r["delivery_id"])), (r["received_at"], r["delivery_id"]))
    return n


def p6_found(d):
    import xxhash

    from runloom.llm import leak_kernel as k

    cut = re.compile(r"[^\W_]+")
    tokens = lambda t: np.array([xxhash.xxh64_intdigest(w) for w in cut.findall(t.lower())], np.uint64)
    items = {tuple(tokens(r["text"]).tolist()): r["item_id"] for r in rows(d, "eval_items", "item_id", "text") if r["text"]}
    held = Counter(x for t in items for x in set(t))
    common = np.sort(np.array([x for x, n in held.items() if n > k.common_above(len(items))], np.uint64))
    index = k.SeedIndex.build(list(items.values()), [np.array(t, np.uint64) for t in items], common)
    docs = [tokens(r["text"]) for r in rows(d, "documents", "text") if r["text"]]
    n = 0
    for at in range(0, len(docs), 1000):
        some = docs[at : at + 1000]
        lens = np.array([len(x) for x in some])
        n += len(index.overlaps(np.concatenate(some), np.repeat(np.arange(len(some)), lens), np.concatenate([[0], np.cumsum(lens)])))
    return n


def p7_mix(d):
    from runloom.llm import mixing
    from runloom.llm.queries import TOKENIZER

    enc = mixing._encoding(Path(TOKENIZER).read_bytes())
    wanted = {r["source"] for r in rows(d, "mix_targets", "source")}
    return sum(len(enc.encode_ordinary(r["text"])) for r in rows(d, "documents", "source", "text") if r["source"] in wanted and r["text"])


def p8_found(d):
    from runloom.llm import encoding_kernel as k

    return sum(k.judge(r["text"])[0] for r in rows(d, "documents", "text"))


def first_loop(d):
    n = 0
    for some in runs(calls(d, "tool_name", "action")).values():
        seen = Counter()
        for r in some:
            s = " ".join(f"{r['tool_name'] or ''} {r['action'] or ''}".split())[:300]
            seen[s] += 1
            if seen[s] == 3:
                n += 1
                break
    return n


def history_compaction(d):
    kept = 0
    for some in runs(calls(d, "tool_name", "observation")).values():
        cost = [max(1, len(r["observation"] or "") // 4) + 4 for r in some]
        role = ["system" if i == 0 else "user" if r["tool_name"] == "search" else "tool" for i, r in enumerate(some)]
        if sum(cost) <= 1500 or "user" not in role:
            kept += len(some)
            continue
        fixed = sum(c for c, r in zip(cost, role) if r == "system")
        chunks, at = [], None
        for c, r in zip(cost, role):
            if r == "user":
                chunks.append([])
            if chunks and r != "system":
                chunks[-1].append(c)
        used = 0
        for at, chunk in enumerate(reversed(chunks)):
            used += sum(chunk)
            if at and used > max(0, 800 - fixed):
                break
            kept += len(chunk)
        kept += role.count("system")
    return kept


def grade_strict(d):
    states = defaultdict(dict)
    strip = re.compile("\x1b\\[[0-9;]*m|\r")
    for r in calls(d, "observation"):
        for line in strip.sub("", r["observation"] or "").split("\n"):
            if line.startswith(("PASSED", "FAILED", "ERROR", "SKIPPED", "XFAIL")):
                p = (line.replace(" - ", " ") if line.startswith("FAILED") else line).split()
                if len(p) >= 2:
                    first, _ = states[r["run_id"]].get(p[1], (p[0], None))
                    states[r["run_id"]][p[1]] = (first, p[0])
    return sum(any(a in ("FAILED", "PASSED") for a, _ in s.values()) for s in states.values())


def exact_topk(d):
    e = rows(d, "embeddings", "vec_id", "embedding")
    ids, v = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], np.float64)
    s = np.round(v[ids % 20 == 0] @ v.T, 6)
    return sum(len(np.lexsort((ids, -x))[:5]) for x in s)


def run_status(d):
    from runloom.operators.monitor import RUNNING, VERIFYING

    found = defaultdict(lambda: [False, False])
    for r in rows(d, "run_log", "run_id", "text"):
        t = r["text"] or ""
        f = found[r["run_id"]]
        f[0] = f[0] or any(w in t for w in VERIFYING)
        f[1] = f[1] or any(w in t for w in RUNNING)
    return len(found)


def carry_forward_kind(d):
    kinds, n = {}, 0
    dated, step = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"), re.compile(r"STEP \d+")
    for r in sorted({(r["run_id"], r["source"], r["byte_offset"], r["text"] or "") for r in rows(d, "run_log", "run_id", "source", "byte_offset", "text")}):
        t = r[3]
        mark = "step" if step.search(t) else "thought" if "THOUGHT:" in t else "action" if "ACTION" in t else "input" if "MODEL INPUT" in t else "observation" if "Observation:" in t else "none" if dated.match(t) else None
        if mark:
            kinds[r[:2]] = mark
        n += 1
    return n


def run_outcomes(d):
    seconds = Counter()
    for r in calls(d, "execution_time"):
        seconds[r["run_id"]] += r["execution_time"] or 0
    return len(runs(turns(d, "exit_reason", "done")))


def trajectory_split(d):
    n = 0
    for some in runs(turns(d, "source")).values():
        n += 1 + sum(a["source"] != b["source"] for a, b in zip(some, some[1:]))
    return n


def main() -> None:
    d = sys.argv[1]
    for f in (p2_pack, p3_found, p5_found, p6_found, p7_mix, p8_found, first_loop, history_compaction, grade_strict, exact_topk, run_status, carry_forward_kind, run_outcomes, trajectory_split):
        begun = time.perf_counter()
        n = f(d)
        print(f"{f.__name__:24} {time.perf_counter() - begun:7.2f} s  {n}")


if __name__ == "__main__":
    main()
