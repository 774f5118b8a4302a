import random

from assetloom.llm.chat import collapse_and_render


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    logs = {c: tuple((r, x) for *_, r, x in sorted(v, key=lambda y: y[:6])) for c, v in convs.items()}
    out = {}
    for c, log in logs.items():
        same = [k for k, v in logs.items() if v == log]
        if c == min(same, key=lambda k: (k is None, k or 0)) and not any(len(v) > len(log) and v[: len(log)] == log for v in logs.values()):
            out[c] = (len(log), len(same), "".join(f"<|im_start|>{r or 'unknown'}\n{x or ''}<|im_end|>\n" for r, x in log))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows, full = [], []
    for c in range(60):
        if full and rng.random() < 0.6:
            base = rng.choice(full)
            log = base[: rng.randint(1, len(base))] + ([("user", f"more {c}")] if rng.random() < 0.3 else [])
        else:
            log = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", f"t{c}"])) for _ in range(rng.randint(1, 9))]
        full.append(log)
        rows += [(c, t, r, x) for t, (r, x) in enumerate(log)]
    rows += [(None, 0, "user", "alone"), (None, 1, "assistant", "yes"), (70, None, "system", "s"), (70, 0, "user", "q"), (71, 0, "user", "big")] + [(71, t, "user", str(t)) for t in range(1, 900)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, ord int, blk string")
    for block in (256, 3):
        parts = {}
        for r in sorted(collapse_and_render(df, block=block).collect(), key=lambda r: r.part):
            n, k, text = parts.get(r.conv, (r.n_turns, r.n_copies, ""))
            parts[r.conv] = (n, k, text + r.rendered)
        assert parts == brute(rows)
    assert collapse_and_render(df.where("false")).count() == 0
