"""The registered queries in DuckDB's SQL, each from the tables alone."""

from __future__ import annotations

WS = "[ \\t\\n\\v\\f\\r]+"
M, BS, V, EOS, SEED = 128, 8, 50254, 2, 42


def strip(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^{WS}|{WS}$', '', 'g'), '')"


def ids(x: str) -> str:
    """Words of stripped text ``x`` as ids."""
    return f"CASE WHEN {x} = '' THEN [] ELSE list_transform(string_split_regex({x}, '{WS}'), lambda w: CAST(3 + CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {V} AS INTEGER)) END"


def n_words(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT)"


def h(*keys: str, epoch: int = 0) -> str:
    return "md5(concat_ws(':', '" + str(SEED + epoch) + "', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


def digest(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


def rep(value: int, n: str) -> str:
    return f"list_transform(range(CAST(greatest({n}, 0) AS BIGINT)), lambda i: {value})"


def head(x: str, n: str) -> str:
    return f"list_slice({x}, 1, {n})"


def set_last(x: str) -> str:
    return f"list_concat(list_slice({x}, 1, len({x}) - 1), [{EOS}])"


def digested(names: str) -> str:
    return ", ".join(f"{digest(n)} AS {n}_md5, CAST(len({n}) AS BIGINT) AS {n}_n" for n in names.split())


TURNS = f"t AS (SELECT conv_id AS idx, turn, lower({strip('role')}) AS r, {strip('text')} AS x, role, text FROM conversations)"
PAIRS = f"""{TURNS}, pairs AS (SELECT idx, prompt, response FROM (
  SELECT idx, arg_min(x, turn) FILTER (WHERE r IN ('user', 'human', 'instruction') AND x <> '') AS prompt,
    arg_min(x, turn) FILTER (WHERE r IN ('assistant', 'gpt', 'bot', 'system_response') AND x <> '') AS response, count(*) AS n FROM t GROUP BY idx)
  WHERE n >= 2 AND prompt IS NOT NULL AND response IS NOT NULL)"""
TRIPLES = f"""{TURNS}, triples AS (SELECT idx, arg_min(x, turn) FILTER (WHERE r = 'system') AS system, arg_min(x, turn) FILTER (WHERE r = 'user') AS prompt,
  (list(x ORDER BY turn) FILTER (WHERE r = 'assistant'))[1] AS chosen, (list(x ORDER BY turn) FILTER (WHERE r = 'assistant'))[2] AS rejected FROM t WHERE x <> '' GROUP BY idx),
prefs AS (SELECT * FROM triples WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL)"""
PIDS = f"{PAIRS}, ids AS (SELECT idx, {ids('prompt')} AS prompt_ids, list_concat({ids('response')}, [{EOS}]) AS response_ids FROM pairs)"
LENS = f"{PAIRS}, lens AS (SELECT idx, {n_words('prompt')} AS p, {n_words('response')} + 1 AS r FROM pairs)"
DOCS = f"docs AS (SELECT doc_id AS idx, source, lang, {n_words('text')} AS len FROM documents)"
PREFIDS = f"{TRIPLES}, ids AS (SELECT idx, {ids('prompt')} AS prompt_ids, list_concat({ids('chosen')}, [{EOS}]) AS chosen_ids, list_concat({ids('rejected')}, [{EOS}]) AS rejected_ids FROM prefs)"


def bucket(x: str, bounds: tuple[int, ...], overflow: bool = False) -> str:
    last = len(bounds) if overflow else len(bounds) - 1
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {last} END"


def label(x: str, bounds: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN '<={b}'" for b in bounds) + f" ELSE '>{bounds[-1]}' END"


def plan(size: int = BS, bucketed: bool = True, name: str = "planned") -> str:
    """(idx, p, r, len, bucket, batch, slot) after LENS."""
    new = f"least(r, {M} - least(p, {M // 2}))"
    which = bucket("p + r", (32, 64, 128)) if bucketed else "0"
    return f"""cut_{name} AS (SELECT idx, CASE WHEN p + r > {M} THEN greatest({M} - {new}, 1) ELSE p END AS p, CASE WHEN p + r > {M} THEN greatest({new}, 1) ELSE r END AS r FROM lens),
{name} AS (SELECT idx, p, r, p + r AS len, bucket, CAST(pos // {size} AS INTEGER) AS batch, CAST(pos % {size} AS INTEGER) AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {h('idx')}, idx) - 1 AS pos FROM (SELECT *, {which} AS bucket FROM cut_{name})))"""


def batched(source: str = "planned", name: str = "b") -> str:
    return f"""{name} AS (SELECT *, 1 - CAST(real AS DOUBLE) / (n * L) AS padding, 1 - CAST(f AS DOUBLE) / L AS first_padding,
  row_number() OVER (ORDER BY {h('bucket', 'batch')}, bucket, batch) - 1 AS step FROM (
  SELECT bucket, batch, count(*) AS n, CAST(sum(len) AS BIGINT) AS real, max(len) AS L, arg_min(len, slot) AS f FROM {source} GROUP BY bucket, batch))"""


def cost(source: str, a: float = 1.0, b: float = 0.0, g: float = 0.0) -> str:
    slots = "CAST(sum(n * L) AS BIGINT)"
    proxy = f"CAST({a} AS DOUBLE) * {slots} + CAST({b} AS DOUBLE) * count(*) + CAST({g} AS DOUBLE) * CAST(sum(n * L * L) AS BIGINT)"
    return f"SELECT count(*) AS batches, {slots} AS padded, CAST(sum(real) AS BIGINT) AS real, 100.0::DOUBLE * ({slots} - CAST(sum(real) AS BIGINT)) / {slots} AS padding_pct, {proxy} AS proxy, ({proxy}) / 3600.0::DOUBLE AS hours FROM {source}"


BATCHES = f"{LENS}, {plan()}, {batched()}"
SHARDS = f"{LENS}, sharded AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, least(p, {M}) AS p, least(r, {M}) AS r FROM lens), s AS (SELECT idx, CAST(idx // 64 AS INTEGER) AS shard, p, r, p + r AS len FROM sharded)"
SHARDPOS = f"""{SHARDS}, sizes AS (SELECT shard, count(*) AS n_samples FROM s GROUP BY shard),
spos AS (SELECT *, CAST(row_number() OVER (ORDER BY {h('shard')}, shard) - 1 AS INTEGER) AS shard_pos FROM sizes),
sstart AS (SELECT *, CAST(coalesce(sum(n_samples) OVER (ORDER BY shard_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shard_start FROM spos),
ins AS (SELECT idx, shard, row_number() OVER (PARTITION BY shard ORDER BY {h('idx')}, idx) - 1 AS k FROM s),
aware AS (SELECT idx, shard, shard_pos, shard_start + k AS pos, CAST((shard_start + k) // {BS} AS INTEGER) AS batch FROM ins JOIN sstart USING (shard))"""
ALPHA = (2.791e-05, 0.0604, 2.361e-08)


def ranked(pad: str, order: str) -> str:
    again = "pos + k * n" if pad == "cyclic" else "CASE WHEN k = 0 THEN pos WHEN pos = 0 THEN n + k - 1 END"
    return f"""{PAIRS}, o AS (SELECT idx, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM pairs),
sized AS (SELECT *, CAST(ceil(n / 4.0) AS BIGINT) AS per FROM o),
ranked AS (SELECT idx, q AS pos, CAST(q // per AS INTEGER) AS rank FROM (SELECT idx, per, {again} AS q FROM sized, range(5) AS g(k)) WHERE q < per * 4)"""


def collated(p: str, r: str, rest: str, n: str) -> str:
    """Digests of the three tensors of p and r (lists) at length n."""
    both = f"list_concat({p}, {r})"
    real = f"(len({p}) + len({r}))"
    tensors = {
        "input_ids": f"list_concat({both}, {rep(0, f'{n} - {real}')})",
        "attention_mask": f"list_concat({rep(1, real)}, {rep(0, f'{n} - {real}')})",
        "labels": f"list_concat(list_concat({rep(-100, f'len({p})')}, {r}), {rep(-100, f'{n} - {real}')})",
    }
    return f"SELECT {rest}, " + ", ".join(f"{x} AS {k}" for k, x in tensors.items())


def stats(source: str, fields: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS BIGINT) AS len FROM {source}" for f in fields)
    p = ", ".join(f"s[least(n * {q} // 100, n - 1) + 1] AS p{q}" for q in (50, 75, 90, 95, 99))
    return f"u AS ({each}), g AS (SELECT field, count(*) AS n, list_sort(list(len)) AS s, avg(len) AS mean_len FROM u GROUP BY field) SELECT field, n, s[1] AS min_len, s[n] AS max_len, mean_len, {p} FROM g"


def instruction_first() -> str:
    new = f"least(len(response_ids), {M} - least(len(prompt_ids), {M // 2}))"
    over = f"len(prompt_ids) + len(response_ids) > {M}"
    return f"SELECT idx, CASE WHEN {over} THEN {set_last(head('prompt_ids', f'{M} - {new}'))} ELSE prompt_ids END AS prompt_ids, CASE WHEN {over} THEN {set_last(head('response_ids', new))} ELSE response_ids END AS response_ids FROM ids"


def response_first() -> str:
    new = f"least(len(prompt_ids), {M} - least(len(response_ids), {M // 2}))"
    over = f"len(prompt_ids) + len(response_ids) > {M}"

    def cut(x: str, n: str) -> str:
        return f"CASE WHEN {over} THEN CASE WHEN least(len({x}), {n}) > 0 THEN {set_last(head(x, n))} ELSE [] END ELSE {x} END AS {x}"

    return f"SELECT idx, {cut('prompt_ids', new)}, {cut('response_ids', f'{M} - {new}')} FROM ids"


def budget_aware(keep: str) -> str:
    p, r = "len(prompt_ids)", "len(response_ids)"
    room = f"({M} - CASE WHEN {p} > 0 THEN 1 ELSE 0 END)"
    over = f"{p} + {r} > {M}"
    left = f"({M} - least({r}, {room}))"
    part = head("prompt_ids", f"{left} - 1") if keep == "head" else f"list_slice(prompt_ids, greatest({p} - greatest({left} - 1, 0), 0) + 1, {p})"
    return f"""SELECT idx, CASE WHEN {over} AND {p} > {left} THEN list_concat({part}, [{EOS}]) ELSE prompt_ids END AS prompt_ids,
  CASE WHEN {over} AND {r} > {room} THEN {set_last(head('response_ids', room))} ELSE response_ids END AS response_ids, {over} AS was_cut FROM ids"""


PREF_CUT = f"""cut AS (SELECT idx, {head('prompt_ids', str(M // 4))} AS prompt_ids, {{sides}} FROM ids)""".replace(
    "{sides}",
    ", ".join(
        f"CASE WHEN {M} - len(prompt_ids) <= 0 THEN [] WHEN len({c}) <= {M} - len(prompt_ids) THEN {c} ELSE {set_last(head(c, f'{M} - len(prompt_ids)'))} END AS {c}"
        for c in ("chosen_ids", "rejected_ids")
    ),
)
DPO = f"""{PREFIDS}, {PREF_CUT}, placed AS (SELECT *, row_number() OVER (ORDER BY {h('idx')}, idx) - 1 AS pos FROM cut),
held AS (SELECT *, 0 AS bucket, CAST(pos // {BS} AS INTEGER) AS batch, CAST(pos % {BS} AS INTEGER) AS slot FROM placed),
longest AS (SELECT *, max(len(prompt_ids) + len(chosen_ids)) OVER (PARTITION BY batch) AS chosen_len, max(len(prompt_ids) + len(rejected_ids)) OVER (PARTITION BY batch) AS rejected_len FROM held)"""


def dpo(labels: bool) -> str:
    columns, names = [], []
    for side in ("chosen", "rejected"):
        real, rest = f"(len(prompt_ids) + len({side}_ids))", f"{side}_len - len(prompt_ids) - len({side}_ids)"
        columns += [f"list_concat(list_concat(prompt_ids, {side}_ids), {rep(0, rest)}) AS {side}_input_ids", f"list_concat({rep(1, real)}, {rep(0, rest)}) AS {side}_mask"]
        names += [f"{side}_input_ids", f"{side}_mask"]
        if labels:
            columns.append(f"list_concat(list_concat({rep(-100, 'len(prompt_ids)')}, {side}_ids), {rep(-100, rest)}) AS {side}_labels")
            names.append(f"{side}_labels")
    return f"WITH {DPO}, made AS (SELECT idx, bucket, batch, slot, CAST(chosen_len AS INTEGER) AS chosen_len, CAST(rejected_len AS INTEGER) AS rejected_len, {', '.join(columns)} FROM longest) SELECT idx, bucket, batch, slot, chosen_len, rejected_len, {digested(' '.join(names))} FROM made"


def hist(source: str, bounds: tuple[int, ...]) -> str:
    edges = [(i, f"<={b}", bounds[i - 1] if i else 0, b) for i, b in enumerate(bounds)] + [(len(bounds), f">{bounds[-1]}", bounds[-1], 1 << 60)]
    rows = ", ".join(f"({i}, '{n}', {a}, {b})" for i, n, a, b in edges)
    return f"SELECT bucket, label, count(len) AS n, 100.0::DOUBLE * count(len) / (SELECT count(*) FROM {source}) AS pct FROM (VALUES {rows}) AS e(bucket, label, low, high) LEFT JOIN {source} ON len > low AND len <= high GROUP BY bucket, label"


def lead(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


TRANSCRIPT = """chats AS (SELECT conv_id AS idx, string_agg(CASE WHEN role = 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' ELSE chr(10) || chr(10) || 'Human: ' END || text, '' ORDER BY turn) AS chosen FROM conversations GROUP BY conv_id)"""
SIX = (64, 128, 256, 512, 1024, 2048)
PATCHED = f"{PIDS}, every AS (SELECT idx, list_concat(prompt_ids, response_ids) AS ids FROM ids)"
SIZE32 = "greatest((len(ids) + 31) // 32, 1)"
STAND = "(SELECT avg(a) AS m, stddev_samp(a) AS s FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS a FROM embeddings))"


def softplus(gap: str) -> str:
    return f"(greatest(-({gap}), 0.0::DOUBLE) + ln(1 + exp(-abs({gap}))))"


def part(k: int) -> str:
    return f"list_sum(CAST(list_slice(embedding, {k * 16 + 1}, {k * 16 + 16}) AS DOUBLE[]))"


def share(epoch: int = 0) -> str:
    """samples and mine (idx, shard, pos, n): the second of four ranks' samples, numbered anew, after PIDS."""
    return f"""samples AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, prompt_ids, response_ids FROM ids),
placed AS (SELECT idx, CAST(idx // 64 AS INTEGER) AS shard, len(prompt_ids) + len(response_ids) AS n, row_number() OVER (ORDER BY {h('idx', epoch=epoch)}, idx) - 1 AS pos, count(*) OVER () AS total FROM samples),
sized AS (SELECT *, CAST(ceil(total / 4.0) AS BIGINT) AS per FROM placed),
mine AS (SELECT idx, shard, n, q AS pos FROM (SELECT *, CASE WHEN k = 0 THEN pos WHEN pos = 0 THEN total + k - 1 END AS q FROM sized, range(5) AS g(k)) WHERE q >= per AND q < 2 * per)"""


def by_shard() -> str:
    """aware (idx, batch, slot), and ins and starts by shard, after share()."""
    return f"""sizes AS (SELECT shard, count(*) AS c FROM mine GROUP BY shard), spots AS (SELECT *, CAST(row_number() OVER (ORDER BY {h('shard')}, shard) - 1 AS INTEGER) AS shard_pos FROM sizes),
starts AS (SELECT *, coalesce(sum(c) OVER (ORDER BY shard_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM spots),
ins AS (SELECT idx, shard, row_number() OVER (PARTITION BY shard ORDER BY {h('pos')}, pos) - 1 AS k FROM mine),
aware AS (SELECT idx, CAST((start + k) // {BS} AS INTEGER) AS batch, CAST((start + k) % {BS} AS INTEGER) AS slot FROM ins JOIN starts USING (shard))"""


def shards_of(columns: str, most: int = M) -> str:
    """The samples of ids as written to shards, and the end of the query."""
    cut = ", ".join(f"{head(c, str(most))} AS {c}" for c in columns.split())
    return f"x AS (SELECT row_number() OVER (ORDER BY {h('idx')}, idx) - 1 AS place, {cut} FROM ids) SELECT place AS idx, CAST(place // 64 AS INTEGER) AS shard, {digested(columns)} FROM x"


def all_sql() -> dict[str, str]:
    pair_digest = digested("prompt_ids response_ids")
    cut = lambda body: f"WITH {PIDS}, cut AS ({body}) SELECT idx, {pair_digest} FROM cut"
    flagged = lambda body: f"WITH {PIDS}, cut AS ({body}) SELECT idx, was_cut, {pair_digest} FROM cut"
    one48 = lambda x: f"CASE WHEN len({x}) > 48 THEN {set_last(head(x, '48'))} ELSE {x} END AS {x}"
    left = "(48 - least(len(prompt_ids), 48))"
    rollout_ids = f"list_concat(list_concat({rep(0, left)}, {head('prompt_ids', '48')}), {rep(0, '16')})"
    rollout_mask = f"list_concat(list_concat({rep(0, left)}, {rep(1, f'48 - {left}')}), {rep(0, '16')})"
    sweep = " UNION ALL ".join(f"SELECT {n} AS batch_size, batches, padded, real, padding_pct FROM ({cost(f'b{n}')})" for n in (8, 16, 32, 64))
    swept = f"{LENS}, " + ", ".join(f"{plan(n, name=f'planned{n}')}, {batched(f'planned{n}', f'b{n}')}" for n in (8, 16, 32, 64))
    disk = "SELECT shard, count(*) AS c, CAST(sum(4 + 4 * (p + r)) + 4 AS BIGINT) AS d, CAST(sum(4 * (p + r) + 56) AS BIGINT) AS m FROM s GROUP BY shard"
    kept = "least(len(prompt_ids), batch_len)"
    return {
        "sft_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
        "nested_chat_pairs": f"WITH {TURNS} SELECT * FROM (SELECT idx, arg_min(x, turn) FILTER (WHERE r = 'user' AND x <> '') AS prompt, arg_min(x, turn) FILTER (WHERE r = 'assistant' AND x <> '') AS response FROM t GROUP BY idx) WHERE prompt IS NOT NULL AND response IS NOT NULL",
        "extracted_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
        "alpaca_style_pairs": f"WITH {TRIPLES} SELECT idx, CASE WHEN coalesce(system, '') <> '' THEN prompt || chr(10) || system ELSE prompt END AS prompt, chosen AS response FROM triples WHERE prompt IS NOT NULL AND chosen IS NOT NULL "
        f"UNION ALL SELECT idx, chr(10) || system, chosen FROM triples WHERE prompt IS NULL AND system IS NOT NULL AND chosen IS NOT NULL",
        "instruction_adapter": f"WITH {TRIPLES} SELECT idx, CASE WHEN coalesce(system, '') <> '' THEN prompt || chr(10) || system ELSE prompt END AS prompt, chosen AS response FROM triples WHERE prompt IS NOT NULL AND chosen IS NOT NULL",
        "inputs_targets_adapter": f"WITH {TRIPLES} SELECT idx, prompt, rejected AS response FROM triples WHERE prompt IS NOT NULL AND rejected IS NOT NULL",
        "orca_prompts": f"WITH {TRIPLES}, x AS (SELECT idx, {strip('''coalesce(system, '') || chr(10) || coalesce(prompt, '')''')} AS prompt, chosen, rejected FROM triples) SELECT * FROM x WHERE prompt <> '' AND chosen IS NOT NULL AND rejected IS NOT NULL",
        "trajectory_prompts": f"WITH {TRIPLES}, lines AS (SELECT idx, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || x, chr(10) ORDER BY turn) AS prompt FROM t WHERE role IN ('user', 'assistant') GROUP BY idx) SELECT idx, {strip('lines.prompt')} AS prompt, chosen, rejected FROM lines JOIN triples USING (idx) WHERE chosen IS NOT NULL AND rejected IS NOT NULL",
        "shp_swap": "SELECT * FROM (SELECT doc_id AS idx, lang AS prompt, CASE WHEN quality = 1 THEN text ELSE source END AS chosen, CASE WHEN quality = 1 THEN source ELSE text END AS rejected FROM documents JOIN labels USING (doc_id)) WHERE prompt <> '' AND chosen <> '' AND rejected <> ''",
        "hh_split": f"""WITH {TRANSCRIPT}, cut AS (SELECT idx, chosen AS c, len(string_split(chosen, chr(10) || chr(10) || 'Assistant:')) AS k, string_split(chosen, chr(10) || chr(10) || 'Assistant:') AS parts FROM chats),
x AS (SELECT idx, {strip("array_to_string(list_slice(parts, 1, k - 1), chr(10) || chr(10) || 'Assistant:')")} AS prompt, {strip('parts[k]')} AS chosen, {strip("parts[k] || ' No.'")} AS rejected FROM cut WHERE k > 1)
SELECT * FROM x WHERE prompt <> '' AND chosen <> '' AND rejected <> ''""",
        "binarised_adapter": f"WITH {TRIPLES}, l AS (SELECT idx, arg_max(text, turn) AS chosen FROM t GROUP BY idx) SELECT idx, prompt, l.chosen AS chosen, rejected FROM l JOIN triples USING (idx) WHERE prompt IS NOT NULL AND rejected IS NOT NULL AND l.chosen <> ''",
        "preference_to_sft": f"WITH {TRIPLES} SELECT idx, prompt, chosen AS response FROM prefs",
        "skip_counts": f"WITH {TRIPLES} SELECT count(*) FILTER (WHERE system IS NOT NULL AND rejected IS NOT NULL) AS processed, count(*) FILTER (WHERE system IS NULL OR rejected IS NULL) AS skipped FROM triples",
        "token_totals": f"WITH {TRIPLES}, x AS (SELECT prompt IS NOT NULL AND rejected IS NOT NULL AS ok, {n_words('prompt')} AS p, {n_words('rejected')} AS r FROM triples) SELECT count(*) FILTER (WHERE ok) AS processed, count(*) FILTER (WHERE NOT ok) AS skipped, CAST(coalesce(sum(p) FILTER (WHERE ok), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(r) FILTER (WHERE ok), 0) AS BIGINT) AS response_tokens FROM x",
        "token_lengths": f"WITH {DOCS} SELECT idx, len FROM docs",
        "token_ids_digest": f"WITH {PIDS} SELECT idx, {pair_digest} FROM ids",
        "ensure_eos": f"WITH {PIDS}, x AS (SELECT idx, response_ids AS ids FROM ids) SELECT idx, {digested('ids')} FROM x",
        "decoded": f"WITH {PAIRS}, w AS (SELECT idx, unnest(string_split_regex(prompt, '{WS}')) AS w, generate_subscripts(string_split_regex(prompt, '{WS}'), 1) AS k FROM pairs), i AS (SELECT idx, k, w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {V} AS id FROM w), v AS (SELECT id, min(w) AS word FROM i GROUP BY id) SELECT idx, string_agg(word, ' ' ORDER BY k) AS text FROM i JOIN v USING (id) GROUP BY idx",
        "length_stats": f"WITH {LENS}, x AS (SELECT p, r, p + r AS total FROM lens), {stats('x', ['p', 'r', 'total'])}",
        "document_length_stats": f"WITH {DOCS}, {stats('docs', ['len'])}",
        "truncation_impact": f"WITH {LENS}, u AS (SELECT 'p' AS field, p AS len FROM lens UNION ALL SELECT 'r', r FROM lens UNION ALL SELECT 'total', p + r FROM lens) SELECT field, count(*) FILTER (WHERE len > {M}) AS n_over, 100.0::DOUBLE * count(*) FILTER (WHERE len > {M}) / count(*) AS pct_over, CAST(sum(greatest(len - {M}, 0)) AS BIGINT) AS tokens_lost FROM u GROUP BY field",
        "length_hist": f"WITH {DOCS} {hist('docs', SIX)}",
        "length_hist_by_lang": f"WITH {DOCS} SELECT lang, {label('len', SIX)} AS label, count(*) AS n, CAST(sum(len) AS BIGINT) AS tokens FROM docs GROUP BY 1, 2",
        "sample_lengths_sft": f"WITH {LENS} SELECT idx, least(p + r, {M}) AS len FROM lens",
        "sample_lengths_pref": f"WITH {TRIPLES} SELECT idx, least({n_words('prompt')}, {M // 4}) + greatest({n_words('chosen')}, {n_words('rejected')}) + 1 AS len FROM prefs",
        "sample_lengths_rollout": f"WITH {LENS} SELECT idx, least(p, 48) AS len FROM lens",
        "long_ratio_decision": f"WITH {DOCS} SELECT count(*) AS n, count(*) FILTER (WHERE len > 512) AS n_long, CAST(count(*) FILTER (WHERE len > 512) AS DOUBLE) / count(*) AS ratio, CASE WHEN CAST(count(*) FILTER (WHERE len > 512) AS DOUBLE) / count(*) >= 0.2 THEN 'COMPRESS' ELSE 'TRUNCATE' END AS strategy FROM docs",
        "source_union_mix": f"WITH {DOCS}, u AS (SELECT source, len FROM docs UNION ALL SELECT 'benchmark', {n_words('text')} FROM benchmark) SELECT source, count(*) AS n, CAST(sum(len) AS BIGINT) AS tokens, coalesce(stddev_samp(len), 0) AS std_len, coalesce(stddev_samp(len), 0) > 30 AS mixed FROM u GROUP BY source",
        "trunc_instruction_first": cut(instruction_first()),
        "trunc_response_first": cut(response_first()),
        "trunc_independent": flagged(f"SELECT idx, {one48('prompt_ids')}, {one48('response_ids')}, len(prompt_ids) > 48 OR len(response_ids) > 48 AS was_cut FROM ids"),
        "trunc_budget_tail": flagged(budget_aware("tail")),
        "trunc_budget_head": flagged(budget_aware("head")),
        "trunc_writer_head": cut(f"SELECT idx, {head('prompt_ids', '48')} AS prompt_ids, {head('response_ids', '48')} AS response_ids FROM ids"),
        "trunc_preference": f"WITH {PREFIDS}, {PREF_CUT} SELECT idx, {digested('prompt_ids chosen_ids rejected_ids')} FROM cut",
        "rollout_leftpad": f"WITH {PIDS}, x AS (SELECT idx, {rollout_ids} AS ids, {rollout_mask} AS mask FROM ids) SELECT idx, {digested('ids mask')} FROM x",
        "seeded_order": f"SELECT doc_id AS idx, lang, row_number() OVER (PARTITION BY lang ORDER BY {h('doc_id', epoch=1)}, doc_id) - 1 AS pos FROM documents",
        "dense_index": f"WITH {PAIRS} SELECT idx AS conv_id, row_number() OVER (ORDER BY idx) - 1 AS idx FROM pairs",
        "rank_shards_cyclic": f"WITH {ranked('cyclic', h('idx') + ', idx')} SELECT * FROM ranked",
        "rank_shards_first": f"WITH {ranked('first', h('idx') + ', idx')} SELECT * FROM ranked",
        "rank_shards_in_order": f"WITH {ranked('cyclic', 'idx')} SELECT * FROM ranked",
        "bucket_assign_clamp": f"WITH {DOCS} SELECT idx, {bucket('len', SIX)} AS bucket FROM docs",
        "bucket_assign_overflow": f"WITH {DOCS} SELECT idx, {bucket('len', SIX, True)} AS bucket FROM docs",
        "bucket_batches": f"WITH {LENS}, {plan()} SELECT idx, bucket, batch, slot FROM planned",
        "rank_bucket_batches": f"""WITH {ranked('cyclic', h('idx') + ', idx')}, lens AS{LENS.split('lens AS', 1)[1]}, {plan()}, x AS (SELECT ranked.pos, idx, rank, bucket, row_number() OVER (PARTITION BY rank, bucket ORDER BY {h('ranked.pos')}, ranked.pos) - 1 AS k FROM ranked JOIN planned USING (idx))
SELECT pos, idx, rank, bucket, CAST(k // {BS} AS INTEGER) AS batch, CAST(k % {BS} AS INTEGER) AS slot FROM x""",
        "batch_order": f"WITH {BATCHES} SELECT bucket, batch, step FROM b",
        "num_batches": f"WITH {LENS}, {plan()}, c AS (SELECT bucket, count(*) AS n FROM planned GROUP BY bucket) SELECT CAST(ceil(sum(n) / {BS}.0) AS BIGINT) AS by_total, CAST(sum(ceil(n / {BS}.0)) AS BIGINT) AS exact FROM c",
        "shard_aware_batches": f"WITH {SHARDPOS} SELECT * FROM aware",
        "window_shard_batches": f"""WITH {SHARDPOS}, w AS (SELECT idx, shard, CAST(shard_pos // 2 AS INTEGER) AS "window", row_number() OVER (PARTITION BY shard_pos // 2 ORDER BY k, shard_pos) - 1 AS turn FROM ins JOIN sstart USING (shard)) SELECT idx, shard, "window", CAST(turn // {BS} AS INTEGER) AS batch, CAST(turn % {BS} AS INTEGER) AS slot FROM w""",
        "shard_manifest": f"WITH {SHARDS}, e AS ({disk}) SELECT count(*) AS shards, CAST(sum(c) AS BIGINT) AS n_samples, CAST(sum(d) AS DOUBLE) / sum(c) AS bytes_per_sample, avg(d) / 1e6 AS avg_shard_mb FROM e",
        "shard_offsets": f'WITH {SHARDPOS} SELECT shard, n_samples, CAST(sum(n_samples) OVER (ORDER BY shard) - n_samples AS BIGINT) AS "begin", CAST(sum(n_samples) OVER (ORDER BY shard) AS BIGINT) AS "end" FROM sizes',
        "locate_index": f"WITH {SHARDS} SELECT idx, shard, idx - shard * 64 AS place FROM s",
        "positional_zip": f"WITH {LENS} SELECT idx AS seq_idx, p, r FROM lens",
        "first_batches": f"WITH {BATCHES} SELECT bucket, batch, n, real, L, padding, first_padding, step FROM b WHERE step < 5",
        "collate_sft": f"WITH {PIDS}, cut AS ({instruction_first()}), lens AS{LENS.split('lens AS', 1)[1]}, {plan()}, z AS (SELECT idx, bucket, batch, slot, cut.prompt_ids, cut.response_ids, CAST(max(len(cut.prompt_ids) + len(cut.response_ids)) OVER (PARTITION BY bucket, batch) AS INTEGER) AS batch_len FROM planned JOIN cut USING (idx)), made AS ({collated('prompt_ids', 'response_ids', 'idx, bucket, batch, slot, batch_len', 'batch_len')} FROM z) SELECT idx, bucket, batch, slot, batch_len, {digested('input_ids attention_mask labels')} FROM made",
        "collate_trim": f"WITH {PIDS}, lens AS{LENS.split('lens AS', 1)[1]}, {plan()}, z AS (SELECT idx, bucket, batch, slot, ids.prompt_ids, ids.response_ids, CAST(least(max(len(ids.prompt_ids) + len(ids.response_ids)) OVER (PARTITION BY bucket, batch), 96) AS INTEGER) AS batch_len FROM planned JOIN ids USING (idx)), y AS (SELECT idx, bucket, batch, slot, batch_len, {head('prompt_ids', kept)} AS prompt_ids, {head('response_ids', f'batch_len - {kept}')} AS response_ids FROM z), made AS ({collated('prompt_ids', 'response_ids', 'idx, bucket, batch, slot, batch_len', 'batch_len')} FROM y) SELECT idx, bucket, batch, slot, batch_len, {digested('input_ids attention_mask labels')} FROM made",
        "collate_reward": dpo(False),
        "collate_dpo": dpo(True),
        "collate_rollout": f"WITH {PIDS}, x AS (SELECT idx, {rollout_ids} AS a, {rollout_mask} AS m FROM ids), lens AS{LENS.split('lens AS', 1)[1]}, {plan()} SELECT bucket, batch, count(*) AS n, md5(array_to_string(flatten(list(a ORDER BY slot)), ',')) AS ids_md5, md5(array_to_string(flatten(list(m ORDER BY slot)), ',')) AS mask_md5 FROM planned JOIN x USING (idx) GROUP BY bucket, batch",
        "pad_sequences": f"WITH {PIDS}, lens AS{LENS.split('lens AS', 1)[1]}, {plan()}, z AS (SELECT idx, bucket, batch, slot, prompt_ids AS x, CAST(max(len(prompt_ids)) OVER (PARTITION BY bucket, batch) AS INTEGER) AS batch_len FROM planned JOIN ids USING (idx)), made AS (SELECT idx, bucket, batch, slot, batch_len, list_concat(x, {rep(0, 'batch_len - len(x)')}) AS ids, list_concat({rep(1, 'len(x)')}, {rep(0, 'batch_len - len(x)')}) AS attention_mask FROM z) SELECT idx, bucket, batch, slot, batch_len, {digested('ids attention_mask')} FROM made",
        "build_labels": f"WITH {PIDS}, x AS (SELECT idx, list_concat({rep(-100, 'len(prompt_ids)')}, response_ids) AS labels FROM ids) SELECT idx, {digested('labels')} FROM x",
        "batch_padding": f"WITH {BATCHES} SELECT bucket, batch, n, real, L, padding, first_padding, step FROM b",
        "epoch_summary": f"""WITH {BATCHES} SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(n * L) AS BIGINT) AS token_slots, avg(L) AS mean_len, coalesce(stddev_pop(L), 0) AS std_len, min(L) AS min_len, max(L) AS max_len, avg(padding) AS mean_padding, coalesce(stddev_pop(padding), 0) AS std_padding,
  arg_max(step, (padding, -step)) AS worst_step, arg_max(L, (padding, -step)) AS worst_len, arg_min(step, (padding, step)) AS best_step, arg_min(L, (padding, step)) AS best_len FROM b""",
        "bucket_breakdown": f"WITH {BATCHES}, f AS (SELECT {label('L', (16, 32, 64, 128))} AS label, * FROM b) SELECT e.label AS label, count(n) AS batches, CAST(coalesce(sum(n), 0) AS BIGINT) AS samples, coalesce(avg(padding), 0) AS mean_padding FROM (VALUES ('<=16'), ('<=32'), ('<=64'), ('<=128'), ('>128')) AS e(label) LEFT JOIN f ON e.label = f.label GROUP BY e.label",
        "bucket_padding": f"WITH {BATCHES} SELECT bucket, count(*) AS batches, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(n * L) AS BIGINT) AS padded, CAST(sum(real) AS BIGINT) AS real, 100.0::DOUBLE * CAST(sum(n * L) - sum(real) AS BIGINT) / CAST(sum(n * L) AS BIGINT) AS padding_pct FROM b GROUP BY bucket",
        "proxy_cost": f"WITH {BATCHES} {cost('b', *ALPHA)}",
        "batch_size_sweep": f"WITH {swept} {sweep}",
        "sweep_choice": f"WITH {swept}, w AS ({sweep}) SELECT arg_min(batch_size, (batches, batch_size)) AS fewest_batches, arg_min(batch_size, (padding_pct, batch_size)) AS least_padding, arg_min(batch_size, (batches, batch_size)) FILTER (WHERE padding_pct < 35) AS balanced FROM w",
        "storage_sizes": f"WITH {SHARDS}, e AS ({disk}) SELECT count(*) AS shards, CAST(sum(d) AS BIGINT) AS disk_bytes, CAST(sum(m) AS BIGINT) AS ram_bytes, avg(d) AS avg_disk, avg(m) AS avg_ram, avg(m) * 4 AS peak_ram FROM e",
        "vram_sizes": f"WITH {BATCHES} SELECT CAST(sum(24 * n * L) AS BIGINT) AS vram_bytes, avg(24 * n * L) AS avg_vram FROM b",
        "cache_hits": f"WITH {SHARDPOS}, f AS (SELECT lag(shard) OVER (ORDER BY pos) IS DISTINCT FROM shard AS miss FROM aware) SELECT count(*) FILTER (WHERE NOT miss) AS hits, count(*) FILTER (WHERE miss) AS misses, 100.0::DOUBLE * count(*) FILTER (WHERE NOT miss) / count(*) AS hit_rate FROM f",
        "pipeline_compare": f"WITH {LENS}, {plan(bucketed=False, name='flat')}, {batched('flat', 'bf')}, {plan()}, {batched()}, x AS ({cost('bf', *ALPHA)}), y AS ({cost('b', *ALPHA)}) SELECT x.padded AS padded_a, y.padded AS padded_b, 100.0::DOUBLE * (x.padded - y.padded) / x.padded AS padded_saved_pct, 100.0::DOUBLE * (x.hours - y.hours) / x.hours AS hours_saved_pct, abs(100.0::DOUBLE * (x.real - y.real) / x.real) AS real_drift_pct, abs(100.0::DOUBLE * (x.real - y.real) / x.real) < 2 AS comparable FROM x, y",
        "mixing_check": f"WITH {LENS} SELECT coalesce(stddev_samp(p + r), 0) AS std_len, coalesce(stddev_samp(p + r), 0) > 30 AS mixed FROM lens",
        "patch_plan": f"WITH {DOCS}, x AS (SELECT idx, len, (len + 511) // 512 AS ps FROM docs) SELECT idx, len, CASE WHEN len > 512 THEN 1 ELSE 0 END AS kind, CASE WHEN len > 512 THEN CAST(ps AS INTEGER) END AS patch_size, CASE WHEN len > 512 THEN CAST((len + ps - 1) // ps AS INTEGER) END AS n_patches, CASE WHEN len > 512 THEN CAST((len + ps - 1) // ps * ps AS INTEGER) END AS padded_len FROM x",
        "global_patch": f"WITH {DOCS} SELECT max(len) AS max_len, CAST((max(len) + 511) // 512 AS INTEGER) AS patch_size FROM docs",
        "patch_split": f"WITH {PATCHED}, z AS (SELECT idx, ids, {SIZE32} AS ps FROM every), y AS (SELECT idx, ids, ps, CAST(unnest(range(CAST((len(ids) + ps - 1) // ps AS BIGINT))) AS INTEGER) AS patch_no FROM z), made AS (SELECT idx, patch_no, list_concat(list_slice(ids, patch_no * ps + 1, patch_no * ps + ps), {rep(0, 'ps - len(list_slice(ids, patch_no * ps + 1, patch_no * ps + ps))')}) AS patch FROM y) SELECT idx, patch_no, {digested('patch')} FROM made",
        "training_patches": f"WITH {PATCHED}, z AS (SELECT len(ids) AS n, (len(ids) + 63) // 64 AS ps FROM every WHERE len(ids) > 64) SELECT CAST(ps AS BIGINT) AS patch_size, CAST(sum((n + ps - 1) // ps) AS BIGINT) AS n FROM z GROUP BY ps",
        "compress_counts": f"WITH {DOCS}, x AS (SELECT len, (len + 511) // 512 AS ps FROM docs) SELECT CASE WHEN len > 512 THEN 1 ELSE 0 END AS kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN len > 512 THEN (len + ps - 1) // ps END), 0) AS BIGINT) AS patches FROM x GROUP BY 1",
        "truncate_counts": f"WITH {PATCHED} SELECT len(ids) > 64 AS was_cut, count(*) AS n, CAST(sum(least(len(ids), 64)) AS BIGINT) AS tokens FROM every GROUP BY 1",
        "adv_normalise": f"WITH st AS {STAND}, x AS (SELECT vec_id AS row_id, list_transform(CAST(embedding AS DOUBLE[]), lambda a: (a - m) / (s + 1e-8)) AS v FROM embeddings, st) SELECT row_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, CAST(len(v) AS BIGINT) AS n FROM x",
        "rollout_minibatches": f"WITH x AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY {h('vec_id', epoch=1)}, vec_id) - 1 AS k FROM embeddings) SELECT row_id, CAST(k // 8 AS INTEGER) AS minibatch, CAST(k % 8 AS INTEGER) AS slot FROM x",
        "grpo_advantage": "SELECT event_id, user_id, round(value - avg(value) OVER (PARTITION BY user_id), 10) AS advantage FROM events",
        "grpo_groups": f"WITH {PAIRS}, x AS (SELECT idx, CAST(k AS INTEGER) AS copy, CAST((idx * 7 + k * 3) % 5 AS DOUBLE) AS reward FROM pairs, range(4) AS g(k)) SELECT *, reward - avg(reward) OVER (PARTITION BY idx) AS advantage FROM x",
        "reward_loss": f"SELECT vec_id AS row_id, round({softplus('CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE)')}, 6) AS loss FROM embeddings",
        "preference_loss": f"SELECT vec_id AS row_id, round({softplus(f'CAST(0.1 AS DOUBLE) * (({part(0)}) - ({part(2)})) - CAST(0.1 AS DOUBLE) * (({part(1)}) - ({part(3)}))')}, 6) AS loss FROM embeddings",
        "tokenbin_roundtrip": f"WITH {PIDS} SELECT {pair_digest} FROM ids",
        "shards_roundtrip": f"WITH {PIDS}, x AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS k, prompt_ids, response_ids FROM ids) SELECT k AS idx, CAST(k // 64 AS INTEGER) AS shard, {pair_digest} FROM x",
        "stream_shuffle": f"WITH u AS (SELECT 'documents:' || doc_id AS id, 'documents' AS source, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'benchmark:' || item_id, 'benchmark', md5(text) FROM benchmark) SELECT *, row_number() OVER (ORDER BY {h('id')}, id) - 1 AS pos FROM u",
        "sequences_zip": f"WITH {PIDS} SELECT {pair_digest} FROM ids",
        "lengths_roundtrip": f"WITH {PIDS} SELECT unnest(['lengths', 'samples']) AS kind, CAST(len(prompt_ids) AS INTEGER) AS prompt_len, CAST(len(response_ids) AS INTEGER) AS response_len FROM ids",
        "compressed_roundtrip": """SELECT 0 AS type, md5(array_to_string([vec_id, label], ',')) AS ids_md5, NULL::INTEGER AS patch_size, NULL::INTEGER AS embed_dim, NULL::BIGINT AS steps, NULL::VARCHAR AS vectors_md5 FROM embeddings WHERE vec_id % 2 = 1
UNION ALL SELECT 1, NULL, 5, 16, 4, md5(array_to_string(list_transform(CAST(CAST(embedding AS FLOAT[]) AS DOUBLE[]), lambda x: CAST(floor(x * 1024) AS BIGINT)), ',')) FROM embeddings WHERE vec_id % 2 = 0""",
        "permissive_read": f"WITH x AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq_idx, {ids("n_name || ' ' || n_name")} AS ids, count(*) OVER () AS n FROM nation) SELECT seq_idx, {digested('ids')} FROM x WHERE seq_idx < n - 1",
        "jsonl_roundtrip": f"WITH {TRIPLES} SELECT 'strict' AS kind, prompt, chosen AS response FROM prefs UNION ALL SELECT 'pairs', prompt, rejected FROM triples WHERE prompt IS NOT NULL AND rejected IS NOT NULL",
        "resolved_sources": f"WITH {TRIPLES} SELECT 'named' AS source, idx, CASE WHEN coalesce(system, '') <> '' THEN prompt || chr(10) || system ELSE prompt END AS prompt, chosen AS response FROM triples WHERE prompt IS NOT NULL AND chosen IS NOT NULL UNION ALL SELECT 'path', idx, prompt, chosen FROM prefs",
        "source_limits": "SELECT * FROM (SELECT doc_id AS idx, 'documents' AS source FROM documents ORDER BY doc_id LIMIT 7) UNION ALL SELECT item_id, 'benchmark' FROM benchmark",
        "stats_sample": f"WITH {DOCS}, few AS (SELECT * FROM docs ORDER BY idx LIMIT 100), {stats('few', ['len'])}",
        "rollout_buffer": f"WITH x AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY {h('vec_id', epoch=1)}, vec_id) - 1 AS k FROM embeddings) SELECT row_id, CAST(k // 100 AS INTEGER) AS minibatch, CAST(k % 100 AS INTEGER) AS slot FROM x",
        "throughput": f"WITH {BATCHES}, rates AS (SELECT sum(n) / 2.0::DOUBLE AS s, sum(real) / 2.0::DOUBLE AS k FROM b) SELECT s AS samples_per_sec, k AS tokens_per_sec, phase, seconds, share_pct FROM rates, (VALUES ('read', 1.5::DOUBLE, 75.0::DOUBLE), ('collate', 0.5::DOUBLE, 25.0::DOUBLE)) AS e(phase, seconds, share_pct)",
        "tokenizer_ids": f"WITH {PIDS} SELECT idx, {digested('prompt_ids')} FROM ids",
        "cache_hits_lru": f"""WITH {SHARDS}, o AS (SELECT shard, row_number() OVER (ORDER BY {h('idx')}, idx) - 1 AS pos FROM s), l AS (SELECT *, lag(pos) OVER (PARTITION BY shard ORDER BY pos) AS before FROM o),
c AS (SELECT l.pos, l.before, count(DISTINCT o.shard) AS n FROM l LEFT JOIN o ON o.pos > l.before AND o.pos < l.pos GROUP BY l.pos, l.before), f AS (SELECT before IS NOT NULL AND n < 3 AS hit FROM c)
SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, 100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*) AS hit_rate FROM f""",
        "loader_bucketed": f"""WITH {PIDS}, {share(3)}, x AS (SELECT idx, pos, {bucket(f'least(n, {M})', (32, 64, 128), True)} AS bucket FROM mine),
y AS (SELECT idx, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {h('pos', epoch=3)}, pos) - 1 AS k FROM x), z AS (SELECT idx, bucket, CAST(k // {BS} AS INTEGER) AS batch, CAST(k % {BS} AS INTEGER) AS slot FROM y),
o AS (SELECT bucket, batch, row_number() OVER (ORDER BY {h('bucket', 'batch', epoch=3)}, bucket, batch) - 1 AS step FROM (SELECT DISTINCT bucket, batch FROM z)) SELECT idx, bucket, batch, slot, step FROM z JOIN o USING (bucket, batch)""",
        "loader_sharded": f"WITH {PIDS}, {share()}, {by_shard()} SELECT idx, 0 AS bucket, batch, slot, CAST(batch AS BIGINT) AS step FROM aware",
        "loader_windowed": f"""WITH {PIDS}, {share()}, {by_shard()}, w AS (SELECT idx, CAST(shard_pos // 2 AS INTEGER) AS bucket, row_number() OVER (PARTITION BY shard_pos // 2 ORDER BY k, shard_pos) - 1 AS turn FROM ins JOIN starts USING (shard)),
z AS (SELECT idx, bucket, CAST(turn // {BS} AS INTEGER) AS batch, CAST(turn % {BS} AS INTEGER) AS slot FROM w), n AS (SELECT bucket, max(batch) + 1 AS n FROM z GROUP BY bucket),
first AS (SELECT bucket, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n) SELECT idx, bucket, batch, slot, start + batch AS step FROM z JOIN first USING (bucket)""",
        "loader_batches": f"WITH {PIDS}, {share()}, {by_shard()}, x AS (SELECT batch, slot, {rollout_ids} AS a, {rollout_mask} AS m FROM aware JOIN samples USING (idx)) SELECT CAST(batch AS BIGINT) AS step, count(*) AS n, md5(array_to_string(flatten(list(a ORDER BY slot)), ',')) AS ids_md5, md5(array_to_string(flatten(list(m ORDER BY slot)), ',')) AS mask_md5 FROM x GROUP BY batch",
        "prepare_sft": f"WITH {TURNS}, pairs AS (SELECT * FROM (SELECT idx, arg_min(x, turn) FILTER (WHERE r = 'user' AND x <> '') AS prompt, arg_min(x, turn) FILTER (WHERE r = 'assistant' AND x <> '') AS response FROM t GROUP BY idx) WHERE prompt IS NOT NULL AND response IS NOT NULL), ids AS{PIDS.split('ids AS', 1)[1]}, {shards_of('prompt_ids response_ids')}",
        "prepare_reward": f"WITH {PREFIDS}, {shards_of('prompt_ids chosen_ids rejected_ids')}",
        "prepare_dpo": f"WITH {PREFIDS}, {shards_of('prompt_ids chosen_ids rejected_ids')}",
        "prepare_rollout": f"WITH {TRIPLES}, ids AS (SELECT idx, {ids('prompt')} AS prompt_ids FROM triples WHERE prompt IS NOT NULL), {shards_of('prompt_ids', 48)}",
        "prepare_truncations": f"WITH x AS (SELECT {n_words('text')} AS p, {n_words('source')} + 1 AS r FROM documents) SELECT 'prompt_ids' AS field, count(*) FILTER (WHERE p > {M} AND r > 1) AS n_truncated FROM x UNION ALL SELECT 'response_ids', count(*) FILTER (WHERE r > {M} AND p > 0) FROM x",
    }
