"""Registered queries: text, intent and recommendations (E1-E10)."""

from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.operators import rules as r
from paramo.operators import text as t
from paramo.plans.catalog import Inputs, query
from paramo.plans.clean import CLEAN_SQL
from paramo.plans.reads import RECENT


def grams(name, source, key, text):
    """CTE text: ``name``(key, term, tf) of the one- and two-word terms."""
    return f"""{name}_w AS (SELECT {key}, [x for x in string_split({CLEAN_SQL.format(c=text)}, ' ') if length(x) >= 2] AS w FROM {source}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {name}_w
  UNION ALL SELECT {key}, a || ' ' || b FROM (SELECT {key}, unnest(w[1:len(w)-1]) AS a, unnest(w[2:len(w)]) AS b FROM {name}_w WHERE len(w) >= 2) z) y GROUP BY 1, 2)"""


@query("txt_tfidf", f"""WITH {grams('tf', 'documents', 'doc_id', 'text')},
 idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
 l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1)
SELECT doc_id, count(*) AS terms, sum(w / len) AS total, max(w / len) AS top, sum(w / len * length(term)) AS mixed FROM w JOIN l USING (doc_id) GROUP BY 1""")
def txt_tfidf(i: Inputs):
    # one checksum row per text: the weights themselves are some millions of rows
    return t.tfidf(i("documents"), "doc_id", "text").groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("top"),
        F.sum(F.col("weight") * F.length("term")).alias("mixed"))


PHRASES = "(VALUES " + ", ".join(f"({k}, '{p}', '{n}')" for k, (p, n) in enumerate(fv.CORPUS)) + ")"
COSINE = f"""corpus AS (SELECT * FROM {PHRASES} AS c(phrase_id, phrase, intent)), {grams('ptf', 'corpus', 'phrase_id', 'phrase')},
 voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM ptf GROUP BY 1),
 pw AS (SELECT phrase_id, term, (1 + ln(tf)) * idf AS w FROM ptf JOIN voc USING (term)),
 pl AS (SELECT phrase_id, sqrt(sum(w * w)) AS len FROM pw GROUP BY 1),
 {grams('mtf', 'b_message', 'msg_id', 'text')},
 mw AS (SELECT msg_id, term, (1 + ln(tf)) * idf AS w FROM mtf JOIN voc USING (term)),
 ml AS (SELECT msg_id, sqrt(sum(w * w)) AS len FROM mw GROUP BY 1),
 sims AS (SELECT mw.msg_id, pw.phrase_id, round(sum(mw.w / ml.len * pw.w / pl.len), 9) AS sim FROM mw JOIN pw USING (term)
   JOIN ml ON ml.msg_id = mw.msg_id JOIN pl ON pl.phrase_id = pw.phrase_id GROUP BY 1, 2),
 best AS (SELECT msg_id, sim, intent FROM (SELECT s.*, c.intent, row_number() OVER (PARTITION BY msg_id ORDER BY sim DESC, phrase_id) AS rn
   FROM sims s JOIN corpus c USING (phrase_id)) q WHERE rn = 1),
 classified AS (SELECT m.msg_id, m.text, CASE WHEN coalesce(sim, 0) < 0.05 THEN 'desconocido' ELSE intent END AS intent, coalesce(sim, 0) AS confidence
   FROM b_message m LEFT JOIN best USING (msg_id))"""


@query("txt_intent_cosine", f"WITH {COSINE} SELECT msg_id, intent, confidence FROM classified", "b_message")
def txt_intent_cosine(i: Inputs):
    return t.intent_by_cosine(i("b_message"), "msg_id", "text", digits=None).drop("text")


_HITS = {k: " + ".join(f"CAST(contains(clean, '{w}') AS INTEGER)" for w in ws) for k, ws in fv.INTENT_KEYWORDS.items()}


@query("txt_intent_keywords", f"""WITH n AS (SELECT msg_id, {', '.join(f'{h} AS {k}' for k, h in _HITS.items())}
  FROM (SELECT msg_id, {CLEAN_SQL.format(c='text')} AS clean FROM b_message) c),
 b AS (SELECT *, greatest({', '.join(_HITS)}) AS best, {' + '.join(_HITS)} AS total FROM n)
SELECT msg_id, CASE WHEN best = 0 THEN 'desconocido' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _HITS)} END AS intent,
 CASE WHEN best = 0 THEN 0 ELSE CAST(best AS DOUBLE) / total END AS confidence FROM b""", "b_message")
def txt_intent_keywords(i: Inputs):
    return t.intent_by_keywords(i("b_message"), "text", digits=None).drop("text")


REGION = "CASE " + " ".join(f"WHEN contains(lower(text), '{n}') THEN '{n[:1].upper() + n[1:]}'" for n in fv.REGION_NAMES) + " END"


@query("txt_extract_region", f"SELECT msg_id, {REGION} AS region FROM b_message", "b_message")
def txt_extract_region(i: Inputs):
    return i("b_message").select("msg_id", t.mentioned_region("text").alias("region"))


PLACED = "SELECT x.* EXCLUDE (region), p.region FROM {b} x JOIN b_place p ON p.place = x.region"


@query("txt_route_answer", f"""WITH {COSINE},
 tolls AS ({PLACED.format(b='b_toll')}), obs AS ({PLACED.format(b='b_sensor')}),
 asked AS (SELECT *, CASE WHEN intent IN ('trafico', 'clima') THEN {REGION} END AS region FROM classified),
 names AS (SELECT unnest({[n for n in fv.REGION_NAMES]}) AS n),
 keys AS (SELECT DISTINCT p.region, upper(n[1:1]) || n[2:] AS asked FROM b_place p, names WHERE contains(lower(p.region), n)
   UNION ALL SELECT DISTINCT region, NULL FROM b_place),
 tr AS (SELECT k.asked, sum(traffic) AS t, sum(evaders) AS e, count(*) AS n FROM tolls x JOIN keys k ON k.region IS NOT DISTINCT FROM x.region GROUP BY 1),
 wk AS (SELECT k.asked, variable, avg(value) AS a, max(value) AS m, count(*) AS n FROM obs x JOIN keys k ON k.region IS NOT DISTINCT FROM x.region
   WHERE obs_date >= (SELECT max(obs_date) FROM obs) - INTERVAL 7 DAY GROUP BY 1, 2),
 six AS (SELECT * FROM b_index ORDER BY month DESC LIMIT 6),
 ans AS (SELECT 'trafico' AS intent, asked, printf('Tránsito total: %d vehículos en %d períodos; %d evasiones (%.2f%%).', CAST(t AS BIGINT), n, CAST(e AS BIGINT), e / t * 100)
     || CASE WHEN e / t * 100 > 10 THEN ' La evasión es alta.' ELSE '' END AS answer FROM tr
  UNION ALL SELECT 'precios', NULL, printf('Índice de insumos en %s: %.1f.', strftime(max(month), '%Y-%m'), arg_max(idx_total, month))
     || printf(' Cambio en 6 meses: %.2f%%.', (arg_max(idx_total, month) - arg_min(idx_total, month)) / arg_min(idx_total, month) * 100) FROM six
  UNION ALL SELECT 'clima', asked, concat_ws(' ', max(CASE WHEN variable = 'precipitacion_mm' THEN printf('Lluvia: promedio %.1f mm, máximo %.1f mm (%d datos).', a, round(m, 1), n) END),
     max(CASE WHEN variable = 'temperatura_c' THEN printf('Temperatura: promedio %.1f °C, máximo %.1f °C (%d datos).', a, round(m, 1), n) END)) FROM wk GROUP BY asked
  UNION ALL SELECT 'resumen', NULL, printf('Registros: %d de peajes, %d de precios, %d de clima.', (SELECT count(*) FROM tolls), (SELECT count(*) FROM b_index), (SELECT count(*) FROM obs))
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{k}', NULL, '{v}')" for k, v in t.STATIC_ANSWERS.items())}) AS f(intent, asked, answer)),
 tips AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{'|'.join(v)}')" for k, v in t.SUGGESTIONS.items())}) AS s(intent, suggestions))
SELECT a.msg_id, a.intent, a.region, coalesce(ans.answer, 'No hay datos para esa consulta.') AS answer, tips.suggestions
FROM asked a LEFT JOIN ans ON ans.intent = a.intent AND ans.asked IS NOT DISTINCT FROM a.region LEFT JOIN tips ON tips.intent = a.intent""",
       "b_message b_toll b_sensor b_index b_place")
def txt_route_answer(i: Inputs):
    places = i("b_place").select(F.col("place").alias("region"), F.col("region").alias("real"))

    def placed(name):
        return i(name).join(places, "region").drop("region").withColumnRenamed("real", "region")

    asked = t.intent_by_cosine(i("b_message"), "msg_id", "text").withColumn(
        "region", F.when(F.col("intent").isin("trafico", "clima"), t.mentioned_region("text")))
    out = t.route(asked, t.answers(placed("b_toll"), i("b_index"), placed("b_sensor")))
    return out.select("msg_id", "intent", "region", "answer", F.array_join("suggestions", "|").alias("suggestions"))


def listed(df):
    return df.select("seq", "rule", "kind", "priority", "metric", "threshold", F.array_join("actions", "|").alias("actions"))


ACT = "(VALUES " + ", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in r.ACTIONS.items()) + ") AS act(rule, actions)"


def with_actions(sql):
    return f"SELECT x.*, act.actions FROM ({sql}) x JOIN {ACT} ON act.rule = x.rule"


PRICE = """SELECT 1 AS seq, 'fertilizante_alto' AS rule, 'precio' AS kind, CASE WHEN fert > 149.5 THEN 'ALTA' ELSE 'MEDIA' END AS priority,
  fert AS metric, CAST(130 AS DOUBLE) AS threshold FROM two WHERE fert > 130
 UNION ALL SELECT 2, 'variacion_alta', 'precio', 'MEDIA', change, 5 FROM two WHERE abs(change) > 5"""
TWO = """two AS (SELECT (SELECT coalesce(idx_fert, 0) * {k} FROM b_index ORDER BY month DESC LIMIT 1) AS fert,
  (arg_max(idx_total, month) - arg_min(idx_total, month)) / arg_min(idx_total, month) * 100 AS change
  FROM (SELECT * FROM b_index ORDER BY month DESC LIMIT 2) q)"""
WEEK = f"SELECT {{g}} variable, coalesce(avg(value), 0) AS a, coalesce(max(value), 0) AS m FROM b_sensor WHERE {RECENT.format(d=7)} GROUP BY ALL"
CLIMATE = """SELECT {g} 3 AS seq, 'sequia' AS rule, 'clima' AS kind, 'ALTA' AS priority, a AS metric, CAST(5 AS DOUBLE) AS threshold FROM wk
  WHERE variable = 'precipitacion_mm' AND a < 5 AND m < 10
 UNION ALL SELECT {g} 4, 'inundacion', 'clima', 'ALTA', a, 150 FROM wk WHERE variable = 'precipitacion_mm' AND a > 150
 UNION ALL SELECT {g} 5, 'calor', 'clima', 'MEDIA', a, 30 FROM wk WHERE variable = 'temperatura_c' AND a > 30"""
EVADE = """SELECT 6 AS seq, 'evasion_alta' AS rule, 'trafico' AS kind, 'MEDIA' AS priority, e AS metric, CAST({th} AS DOUBLE) AS threshold
  FROM (SELECT sum(evaders) / sum(traffic) * 100 AS e FROM b_toll) q WHERE e > {th}"""


@query("rec_price_rules", f"WITH {TWO.format(k=1.4)}, p AS ({PRICE}) {with_actions('SELECT * FROM p')}", "b_index")
def rec_price_rules(i: Inputs):
    return listed(r.price_rules(i("b_index").withColumn("idx_fert", F.col("idx_fert") * 1.4)))


@query("rec_climate_rules", f"WITH wk AS ({WEEK.format(g='region,')}), c AS ({CLIMATE.format(g='region,')}) {with_actions('SELECT * FROM c')}", "b_sensor")
def rec_climate_rules(i: Inputs):
    df = r.climate_rules(i("b_sensor"), by=["region"])
    return df.withColumn("actions", F.array_join("actions", "|"))


@query("rec_evasion_rule", f"WITH e AS ({EVADE.format(th=2)}) {with_actions('SELECT * FROM e')}", "b_toll")
def rec_evasion_rule(i: Inputs):
    return listed(r.evasion_rule(i("b_toll"), threshold=2.0))


ALERTS = f"""{TWO.format(k=1)}, wk AS ({WEEK.format(g='')}), al AS ({PRICE} UNION ALL {CLIMATE.format(g='')} UNION ALL {EVADE.format(th=15)}),
 co AS (SELECT 0 AS seq, 'compuesta' AS rule, 'riesgo_compuesto' AS kind, CASE WHEN bool_or(priority = 'ALTA') THEN 'ALTA' ELSE 'MEDIA' END AS priority,
  CAST(count(*) AS DOUBLE) AS metric, CAST(2 AS DOUBLE) AS threshold FROM al HAVING bool_or(kind = 'precio') AND bool_or(kind = 'clima'))"""


def active_alerts(i: Inputs):
    return r.price_rules(i("b_index")).unionByName(r.climate_rules(i("b_sensor"))).unionByName(r.evasion_rule(i("b_toll")))


@query("rec_compound", f"WITH {ALERTS} {with_actions('SELECT * FROM co')}", "b_index b_sensor b_toll")
def rec_compound(i: Inputs):
    return listed(r.compound(active_alerts(i)))


@query("rec_prioritised", f"""WITH {ALERTS}, every AS (SELECT * FROM al UNION ALL SELECT * FROM co
  UNION ALL SELECT 7, 'precio_estable', 'precio', 'BAJA', 0, 0 WHERE (SELECT count(*) FROM al) = 0
  UNION ALL SELECT 8, 'clima_estable', 'clima', 'BAJA', 0, 0 WHERE (SELECT count(*) FROM al) = 0)
{with_actions("SELECT * FROM every ORDER BY CASE priority WHEN 'ALTA' THEN 0 WHEN 'MEDIA' THEN 1 ELSE 2 END, seq LIMIT 8")}""", "b_index b_sensor b_toll")
def rec_prioritised(i: Inputs):
    return listed(r.prioritised(i("b_index"), i("b_sensor"), i("b_toll")))
