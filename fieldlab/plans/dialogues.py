"""Batch understanding of the conversations' turns, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators import dialogue as d
from fieldlab.sources.tables import table

#: What a turn says, by its key; {p}, {q} are parts (players), {t}, {u} nations (teams); None: its own text.
SAID = (
    "What is {p}'s OPS?", "what about his home runs", "and the {t}", "Show the {t} roster", "how likely is {p} to hit a home run", "Start over.", "what is his batting average this season, 2023", "when do they play next",
    "compare {p} and {q}", "predict that player again", "also strikeouts", "actually {p}", "{t} versus {u} tomorrow", "who wins that game", "is the database connected", None,
)


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, ts, text: every turn of the conversations says what its key gives, of parts and nations; the hours
    between the turns of a conversation are 12, 18, 24 or 30."""
    parts, nations = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    n, m = parts.count(), nations.count()
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 7 + F.col("turn") * 3)
    for name, of, key, value, size in (("p", parts, "p_partkey", "p_name", n), ("q", parts, "p_partkey", "p_name", n), ("t", nations, "n_nationkey", "n_name", m), ("u", nations, "n_nationkey", "n_name", m)):
        shift = {"p": 0, "q": 1, "t": 0, "u": 3}[name]
        side = of.select(F.col(key).alias(f"{name}_key"), F.col(value).alias(name))
        rows = rows.join(side, F.expr(f"(k + {shift}) % {size}") == F.col(f"{name}_key"), "left")
    texts = [F.col("text") if s is None else _filled(s) for s in SAID]
    at = ((F.col("conv_id") * 5 + F.col("turn") * 11) % len(SAID)).cast("int")
    hours = F.col("turn") * (12 + 6 * (F.col("conv_id") % 4))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + 3600 * hours)
    return rows.select("conv_id", "turn", ts.alias("ts"), F.get(F.array(*texts), at).alias("text"))


def _filled(pattern: str) -> F.Column:
    out = F.lit(pattern)
    for name in "pqtu":
        if "{" + name + "}" in pattern:
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    return out


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias, kind, name: parts are players, nations are teams."""
    names = {"player": table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "team": table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))}
    rows = [df.distinct().select(d.normalized(F.col("name")).alias("alias"), F.lit(kind).alias("kind"), "name") for kind, df in names.items()]
    return rows[0].unionByName(rows[1])


def batch_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn means, with what it takes from the turns before it."""
    out = d.understand(dialogue_turns(spark, sf_dir), catalogue(spark, sf_dir))
    return out.drop("memory", "at").withColumn("confidence", F.round("confidence", 6))


QUERIES = {"batch_understanding": batch_understanding}


def _sql() -> str:
    says = lambda phrases: "(" + " OR ".join(f"contains(s, ' {p} ')" for p in phrases) + ")"
    begins = lambda prefixes: "(" + " OR ".join(f"starts_with(low, '{p}')" for p in prefixes) + ")"
    quoted = lambda text: text.replace("'", "''")
    hit = lambda words: "CASE " + " ".join(f"WHEN contains(s, ' {a} ') THEN '{c}'" for a, c in sorted(words, key=lambda x: (-len(x[0]), [-ord(y) for y in x[0]]))) + " END"
    met = {"phrase": "contains(s, ' {} ')", "word": "contains(s, ' {} ')", "prefix": "starts_with(low, '{}')", "regex": "regexp_matches(low, '{}')"}
    one = lambda r: says(r.pattern.split()).replace(" OR ", " AND ") if r.mode == "set" else met[r.mode].format(r.pattern)
    ev = " UNION ALL ".join(f"SELECT id, '{r.intent}' AS intent, {r.weight}::DOUBLE AS w, {int(r.weight > 0)} AS n FROM f WHERE {one(r)}" for r in d.RULES)
    there = {"player": "np >= 1", "team": "nt >= 1", "players": "np >= 2", "teams": "nt >= 2", "statistic": "statistic IS NOT NULL", "outcome": "outcome IS NOT NULL"}
    ev += " UNION ALL " + " UNION ALL ".join(f"SELECT id, '{i}', {w}::DOUBLE, 1 FROM m WHERE {' AND '.join(there[x] for x in needs.split('+'))}" for needs, i, w in d.NAMED)
    net = lambda i: f"coalesce(nets['{i}'], 0)"
    firm = {"@players": "WHEN np >= 2 THEN 'compare_players'", "@teams": "WHEN nt >= 2 THEN 'compare_teams'", "@stat": f"WHEN np + nt > 0 AND greatest({net('stat_request')}, {net('player_stat_request')}, {net('team_stat_request')}) >= 4 THEN CASE WHEN np > 0 THEN 'player_stat_request' ELSE 'team_stat_request' END"}
    firm_case = " ".join(firm.get(i, f"WHEN {net(i)} >= {least} THEN '{i}'") for i, least in d.FIRM)
    needs = " ".join(f"WHEN intent = '{i}' AND {'coalesce(xp, xt)' if k == 'who' else {'player': 'xp', 'team': 'xt', 'outcome': 'xo', 'statistic': 'xs'}[k]} IS NULL THEN '{'player' if k == 'who' else k}'" for i, ks in d.NEEDS.items() for k in ks)
    said = " ".join(f"WHEN {k} THEN " + ("text" if s is None else f"replace(replace(replace(replace('{quoted(s)}', '{{p}}', p), '{{q}}', q), '{{t}}', t), '{{u}}', u)") for k, s in enumerate(d_said()))
    order = ", ".join(f"'{i}'" for i in d.ORDER)
    T = d.TAKEN
    return f"""WITH RECURSIVE k AS (SELECT *, conv_id * 7 + turn * 3 AS k FROM conversations), np_ AS (SELECT count(*) AS n FROM part), nn_ AS (SELECT count(*) AS n FROM nation),
    w AS (SELECT conv_id, turn, text, a.p_name AS p, b.p_name AS q, c.n_name AS t, e.n_name AS u FROM k, np_, nn_ JOIN part a ON a.p_partkey = k.k % np_.n JOIN part b ON b.p_partkey = (k.k + 1) % np_.n JOIN nation c ON c.n_nationkey = k.k % nn_.n JOIN nation e ON e.n_nationkey = (k.k + 3) % nn_.n),
    x AS (SELECT conv_id, turn, row_number() OVER () AS id, turn * (12 + 6 * (conv_id % 4)) AS ts, CASE (conv_id * 5 + turn * 11) % {len(d_said())} {said} END AS text FROM w),
    l AS (SELECT *, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS low FROM x), sp AS (SELECT *, ' ' || low || ' ' AS s FROM l),
    f AS (SELECT *, {hit(d.STATISTICS)} AS statistic, {hit(d.OUTCOMES)} AS outcome, nullif(regexp_extract(low, '\\b(today|tonight|tomorrow|yesterday)\\b', 1), '') AS date, nullif(regexp_extract(low, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') AS season,
      {says(("vs", "versus", "against", "at"))} AS versus, {says(d.RESETS)} AS reset, {begins(d.CORRECTIONS)} AS correction, {begins(d.ELLIPTICAL)} AS elliptical, {says(d.CONTINUATIONS)} AS continuation,
      {says(d.PLAYER_PRONOUNS)} AS of_player, {says(d.TEAM_PRONOUNS)} AS of_team, {says(d.GAME_PRONOUNS)} AS of_game, {says(d.STATISTIC_PRONOUNS)} AS of_statistic, {says(d.OUTCOME_PRONOUNS)} AS of_outcome FROM sp),
    c AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS alias, 'player' AS kind, p_name AS name FROM part UNION SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), 'team', n_name FROM nation),
    h AS (SELECT id, kind, name, min(position(' ' || alias || ' ' IN s)) AS pos FROM f JOIN c ON contains(s, ' ' || alias || ' ') GROUP BY ALL),
    g AS (SELECT id, list(name ORDER BY pos, name) FILTER (kind = 'player') AS ps, list(name ORDER BY pos, name) FILTER (kind = 'team') AS ts_ FROM h GROUP BY id),
    m AS (SELECT f.*, ps[1] AS player, ts_[1] AS team, coalesce(len(ps), 0) AS np, coalesce(len(ts_), 0) AS nt, CASE WHEN versus AND len(ts_) > 1 THEN ts_[1] || ' vs ' || ts_[2] END AS game FROM f LEFT JOIN g ON g.id = f.id),
    e AS ({ev}), ei AS (SELECT id, intent, sum(w) AS net, sum(n) AS n FROM e GROUP BY 1, 2), r AS (SELECT id, map(list(intent), list(net)) AS nets, map(list(intent), list(n)) AS mets, list(intent ORDER BY net DESC, list_position([{order}], intent)) FILTER (net > 0) AS ranked FROM ei GROUP BY id),
    i0 AS (SELECT m.*, nets, mets, ranked, CASE {firm_case} END AS firm FROM m LEFT JOIN r ON r.id = m.id),
    i1 AS (SELECT *, coalesce(firm, ranked[1], 'general') AS base FROM i0),
    i2 AS (SELECT *, CASE WHEN base IN ('help', 'database_status') THEN base WHEN np > 1 THEN 'compare_players' WHEN nt > 1 THEN 'compare_teams' WHEN np > 0 AND (outcome IS NOT NULL OR base = 'general_probability') THEN 'player_probability'
      WHEN nt > 0 AND (outcome IS NOT NULL OR base = 'general_probability') THEN 'team_probability' WHEN np > 0 AND base = 'general' THEN 'player_info' WHEN nt > 0 AND base = 'general' THEN 'team_info' ELSE base END AS intent FROM i1),
    i3 AS (SELECT *, coalesce(nets[intent], 0) AS net, list_filter(ranked, lambda z: z <> intent)[1] AS second FROM i2),
    y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts, turn, low) AS pos, CASE WHEN net <= 0 THEN 0.3 ELSE least(0.99, 0.3 + 0.48 * (1 - exp(-net / 10)) + 0.18 * greatest(0, exp(-coalesce(nets[second], 0) / 10) - exp(-net / 10)) + least(0.14, 0.025 * mets[intent]) + CASE WHEN firm IS NULL THEN 0 ELSE 0.05 END) END::DOUBLE AS sure FROM i3),
    z AS (SELECT conv_id, turn, pos, ts, kind, intent, xp, xt, xg, xs, xo, xd, xy, taken, asks, begun, sure, sp, n_said, turns, hp, ht, hg, hs, ho, hd, hy, updated FROM (SELECT 0::BIGINT AS conv_id, 0::BIGINT AS turn, 0::BIGINT AS pos, 0::BIGINT AS ts, '' AS kind, '' AS intent, '' AS xp, '' AS xt, '' AS xg, '' AS xs, '' AS xo, '' AS xd, '' AS xy, '' AS taken, '' AS asks, '' AS begun, 0::DOUBLE AS sure, 0::DOUBLE AS sp, 0::BIGINT AS n_said, 0::BIGINT AS turns,
        '' AS hp, '' AS ht, '' AS hg, '' AS hs, '' AS ho, '' AS hd, '' AS hy, 0::BIGINT AS updated) WHERE false
      UNION ALL SELECT DISTINCT conv_id, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, '', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', '', '', 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL::BIGINT FROM y
      UNION ALL SELECT conv_id, turn, pos, ts, kind, intent, xp, xt, xg, xs, xo, xd, xy, taken, asks, begun, sure, sp, n_said, CASE WHEN asks = '' THEN turns + 1 ELSE turns END,
        CASE WHEN asks <> '' THEN hp WHEN team IS NOT NULL THEN NULL ELSE coalesce(xp, hp) END, CASE WHEN asks <> '' THEN ht ELSE coalesce(xt, ht) END, CASE WHEN asks <> '' THEN hg WHEN player IS NOT NULL AND game IS NULL THEN NULL ELSE coalesce(xg, hg) END,
        CASE WHEN asks <> '' THEN hs ELSE coalesce(xs, hs) END, CASE WHEN asks <> '' THEN ho ELSE coalesce(xo, ho) END, CASE WHEN asks <> '' THEN hd ELSE coalesce(xd, hd) END, CASE WHEN asks <> '' THEN hy ELSE coalesce(xy, hy) END, CASE WHEN asks <> '' THEN updated ELSE ts END
      FROM (SELECT *, CASE WHEN low = '' THEN 'message' {needs} ELSE '' END AS asks, concat_ws(',', CASE WHEN player IS NULL AND xp IS NOT NULL THEN 'player' END, CASE WHEN team IS NULL AND xt IS NOT NULL THEN 'team' END, CASE WHEN game IS NULL AND xg IS NOT NULL THEN 'game' END, CASE WHEN statistic IS NULL AND xs IS NOT NULL THEN 'statistic' END, CASE WHEN outcome IS NULL AND xo IS NOT NULL THEN 'outcome' END) AS taken,
          (player IS NOT NULL)::INT + (team IS NOT NULL)::INT + (game IS NOT NULL)::INT + (statistic IS NOT NULL)::INT + (outcome IS NOT NULL)::INT + (xd IS NOT NULL)::INT + (xy IS NOT NULL)::INT AS n_said,
          CASE WHEN player IS NULL AND xp IS NOT NULL THEN CASE WHEN of_player THEN {T["player_pronoun"]} ELSE {T["player_ellipsis"]} END ELSE 0 END + CASE WHEN team IS NULL AND xt IS NOT NULL THEN CASE WHEN of_team THEN {T["team_pronoun"]} ELSE {T["team_ellipsis"]} END ELSE 0 END
          + CASE WHEN game IS NULL AND xg IS NOT NULL THEN {T["game_pronoun"]} ELSE 0 END + CASE WHEN statistic IS NULL AND xs IS NOT NULL THEN {T["statistic"]} ELSE 0 END + CASE WHEN outcome IS NULL AND xo IS NOT NULL THEN {T["outcome"]} ELSE 0 END AS sp
        FROM (SELECT *, coalesce(xt1, CASE WHEN elliptical AND xp IS NULL AND xt1 IS NULL AND statistic IS NOT NULL THEN ht END) AS xt FROM (SELECT *, coalesce(xp1, CASE WHEN elliptical AND xt1 IS NULL AND coalesce(statistic, outcome) IS NOT NULL THEN hp END) AS xp
          FROM (SELECT *, coalesce(player, CASE WHEN of_player THEN hp END) AS xp1, coalesce(team, CASE WHEN of_team THEN ht END) AS xt1, coalesce(game, CASE WHEN of_game THEN hg END) AS xg, coalesce(statistic, CASE WHEN of_statistic THEN hs END) AS xs, coalesce(outcome, CASE WHEN of_outcome THEN ho END) AS xo, date AS xd, season AS xy,
            CASE WHEN low = '' THEN 'none' WHEN reset THEN 'reset' WHEN correction THEN 'correction' WHEN of_player AND player IS NULL OR of_team AND team IS NULL OR of_game AND game IS NULL THEN 'pronoun' WHEN elliptical THEN 'elliptical' WHEN continuation THEN 'continuation' ELSE 'none' END AS kind
          FROM (SELECT y.*, b.begun, CASE WHEN b.begun = '' THEN v.hp END AS hp, CASE WHEN b.begun = '' THEN v.ht END AS ht, CASE WHEN b.begun = '' THEN v.hg END AS hg, CASE WHEN b.begun = '' THEN v.hs END AS hs, CASE WHEN b.begun = '' THEN v.ho END AS ho, CASE WHEN b.begun = '' THEN v.hd END AS hd, CASE WHEN b.begun = '' THEN v.hy END AS hy, CASE WHEN b.begun = '' THEN v.turns ELSE 0 END AS turns, CASE WHEN b.begun = '' THEN v.updated END AS updated
            FROM z v JOIN y ON y.conv_id = v.conv_id AND y.pos = v.pos + 1, LATERAL (SELECT CASE WHEN y.reset THEN 'reset' WHEN y.ts - coalesce(v.updated, v.ts) >= 24 THEN 'expired' ELSE '' END AS begun) b))))))
    SELECT conv_id, turn, kind, intent, xp AS player, xt AS team, xg AS game, xs AS statistic, xo AS outcome, xd AS date, xy AS season, taken, asks, begun,
      round(least(0.99, 0.3 + CASE WHEN intent <> 'general' THEN 0.15 ELSE 0 END + 0.1 * ({d.SAID} * n_said + sp) + 0.18 * sure + CASE WHEN taken <> '' THEN 0.03 ELSE 0 END - CASE WHEN begun = 'expired' THEN 0.08 ELSE 0 END), 6) AS confidence, turns FROM z WHERE pos > 0"""


def d_said() -> tuple[str | None, ...]:
    return SAID


ORACLE_SQL = {"batch_understanding": _sql()}
