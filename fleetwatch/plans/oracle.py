"""The same queries as plain SQL for another engine, written from the definitions."""

from __future__ import annotations

from fleetwatch.fixed_values import ALL_NORMAL_MESSAGE, NO_ANOMALY, WINDOW_FRACTION
from fleetwatch.functions.requests import COMPARE_LINES, COMPARE_PODS, REVIEW_LOG
from fleetwatch.operators.detector import MAD_SCALE, Thresholds
from fleetwatch.plans.limits import KEEN
from fleetwatch.operators.texts import PART_BYTES, PART_PODS, PART_VALUES
from fleetwatch.plans.registered import SMALL_PART, WEEK
from fleetwatch.plans.registered_files import TINY_PART

KEYS = "service, pod, node"
HOUR = 3_600_000_000

SAMPLES = """samples AS (
  SELECT event_type AS service, 'pod-' || (user_id % 15) AS pod, 'node-' || (user_id % 3) AS node,
         ts AS "timestamp", value AS cpuusage, event_id AS seq
  FROM events)"""

UPLOAD = """samples AS (
  SELECT event_type AS service, CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'cpu_limit' END AS metric,
         'pod-' || (user_id % 15) AS pod, 'node-' || (user_id % 3) AS node,
         ts AS "timestamp", value AS cpuusage, event_id AS seq
  FROM events)"""

LOGS = """logs AS (
  SELECT 'r' || (user_id % 3) AS region, event_type AS log_group, 'pod-' || (user_id % 15) AS log_stream,
         ts AS event_time, event_id AS seq, props AS message
  FROM events)"""

ANSWERS = f"""answers AS (
  SELECT event_id AS answer_id, event_type AS service,
         CASE WHEN user_id % 2 = 0 THEN 'text' ELSE 'chart' END AS path,
         CASE event_id % 8
           WHEN 0 THEN '<result>' || chr(10) || ' {NO_ANOMALY} ' || chr(10) || '</result>'
           WHEN 1 THEN '<result><pod1> pod-' || (user_id % 15) || ' </pod1>' || chr(10) || '<pod2>' || chr(10)
                       || 'pod-1' || (user_id % 5) || chr(10) || '</pod2></result>'
           WHEN 2 THEN '没有'
           WHEN 3 THEN '<pod1>pod-' || (user_id % 15) || '</pod1>'
           WHEN 4 THEN '<result>{NO_ANOMALY}</result><pod1>pod-' || (user_id % 15) || '</pod1>'
           WHEN 5 THEN '<pod1>pod-' || (user_id % 15) || '</pod2>'
           WHEN 6 THEN '<pod1>pod-' || (user_id % 15)
         END AS answer
  FROM events),
parsed AS (
  SELECT answer_id, service, path,
         regexp_replace(regexp_extract(coalesce(answer, ''), '(?s)<result>(.*?)</result>', 1), '^\\s+|\\s+$', '', 'g') AS result,
         [regexp_replace(x, '^\\s+|\\s+$', '', 'g')
          FOR x IN regexp_extract_all(coalesce(answer, ''), '(?s)<pod\\d+>(.*?)</pod\\d+>', 1)] AS pods
  FROM answers),
named AS (
  SELECT service, path, unnest(pods) AS pod FROM parsed WHERE NOT contains(result, '{NO_ANOMALY}'))"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def window(hours: float, by: str = "service") -> str:
    length = round(hours * HOUR)
    return f"""ends AS (
  SELECT {by}, min("timestamp") AS first_time, max("timestamp") AS last_time,
         date_diff('microsecond', min("timestamp"), max("timestamp")) AS span
  FROM samples GROUP BY ALL),
starts AS (
  SELECT *, CASE WHEN span > {length}
      THEN first_time + to_microseconds(CAST(round_even(CAST(span - {length} AS DOUBLE) * CAST({WINDOW_FRACTION} AS DOUBLE), 0) AS BIGINT))
      ELSE first_time END AS window_start
  FROM ends),
windows AS (
  SELECT {by}, window_start,
         CASE WHEN span > {length} THEN window_start + to_microseconds({length}) ELSE last_time END AS window_end
  FROM starts),
cut AS (
  SELECT s.* FROM samples s JOIN windows w USING ({by}) WHERE s."timestamp" BETWEEN w.window_start AND w.window_end),
down AS (
  SELECT * EXCLUDE (pos) FROM (
    SELECT *, row_number() OVER (PARTITION BY {by}, pod, node ORDER BY "timestamp", seq) AS pos FROM cut)
  WHERE (pos - 1) % 2 = 0)"""


def detector(scope: str, by: str = "service", t: Thresholds = Thresholds()) -> str:
    """CTEs from scoped rows to one scored table per rule."""
    rows = "down" if scope == "window" else "samples"
    keys = f"{by}, pod, node"
    cut = t.spike_cut * MAD_SCALE
    return f"""near AS (
  SELECT *, list(cpuusage) OVER (PARTITION BY {keys} ORDER BY "timestamp", seq
                                 ROWS BETWEEN {t.spike_reach} PRECEDING AND {t.spike_reach} FOLLOWING) AS around,
         date_diff('microsecond', lag("timestamp") OVER (PARTITION BY {keys} ORDER BY "timestamp", seq), "timestamp") AS since
  FROM {rows} WHERE "timestamp" IS NOT NULL AND cpuusage IS NOT NULL),
centred AS (SELECT *, list_aggregate(around, 'median') AS centre FROM near),
gapped AS (SELECT *, list_aggregate([abs(x - centre) FOR x IN around], 'median') AS gap FROM centred),
smoothed AS (
  SELECT {keys}, "timestamp", seq, cpuusage, since,
         CASE WHEN abs(cpuusage - centre) > CAST({cut} AS DOUBLE) * gap THEN centre ELSE cpuusage END AS smooth
  FROM gapped),
pods AS (
  SELECT {keys}, median(smooth) AS middle, min(smooth) AS low, max(smooth) AS top,
         stddev_samp(smooth) AS spread, count(*) AS n
  FROM smoothed GROUP BY ALL),
services AS (
  SELECT {by}, median(middle) AS service_middle, min(low) AS service_low, max(top) AS service_top,
         median(spread) AS service_spread
  FROM pods GROUP BY ALL),
placed AS (SELECT * FROM pods JOIN services USING ({by})),
gaps AS (SELECT {by}, median(abs(middle - service_middle)) AS peer_gap FROM placed GROUP BY ALL),
level_score AS (
  SELECT {keys}, (middle - service_middle) / nullif(greatest({MAD_SCALE}::DOUBLE * peer_gap,
         {t.level_floor}::DOUBLE * (service_top - service_low)), 0) AS score
  FROM placed JOIN gaps USING ({by})),
axis_score AS (
  SELECT {keys}, abs(middle - service_middle) / nullif(service_top - service_low, 0) AS score FROM placed),
flat_score AS (
  SELECT {keys}, spread / nullif(service_spread, 0) AS score,
         spread < {t.flat_share}::DOUBLE * service_spread AND n >= {t.flat_rows} AS hit FROM placed),
runs AS (
  SELECT *, count(*) FILTER (WHERE smooth < {t.high_value} OR since > {t.high_gap_minutes * 60_000_000})
          OVER (PARTITION BY {keys} ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS run
  FROM smoothed),
stretches AS (
  SELECT {keys}, run, date_diff('microsecond', min("timestamp"), max("timestamp")) AS len
  FROM runs WHERE smooth >= {t.high_value} GROUP BY ALL),
longest AS (SELECT {keys}, max(len) AS len FROM stretches GROUP BY ALL),
high_score AS (
  SELECT {keys}, coalesce(len, 0) / 60000000.0::DOUBLE AS score,
         len IS NOT NULL AND len / 60000000.0::DOUBLE >= {t.high_minutes} AND service_middle < {t.high_value} AS hit
  FROM placed LEFT JOIN longest USING ({keys})),
buckets AS (
  SELECT {keys}, epoch_us("timestamp") // {t.shape_minutes * 60_000_000} AS bucket, avg(smooth) AS pod_level
  FROM smoothed GROUP BY ALL),
lines AS (SELECT {by}, bucket, median(pod_level) AS line FROM buckets GROUP BY ALL),
shapes AS (
  SELECT {keys}, covar_pop(pod_level, line) AS together, stddev_pop(pod_level) AS one, stddev_pop(line) AS two, count(*) AS n
  FROM buckets JOIN lines USING ({by}, bucket) GROUP BY ALL),
shape_score AS (
  SELECT {keys}, CASE WHEN one > 1e-9 AND two > 1e-9 THEN together / (one * two) END AS score, n FROM shapes),
detect_level AS (SELECT {keys}, score, coalesce(abs(score) > {t.level_cut}, false) AS flagged FROM level_score),
detect_axis AS (SELECT {keys}, score, coalesce(score > {t.axis_cut}, false) AS flagged FROM axis_score),
detect_flat AS (SELECT {keys}, score, coalesce(hit, false) AS flagged FROM flat_score),
detect_high AS (SELECT {keys}, score, coalesce(hit, false) AS flagged FROM high_score),
detect_shape AS (
  SELECT {keys}, score, coalesce(score < {t.shape_cut} AND n >= {t.shape_buckets}, false) AS flagged FROM shape_score),
findings AS (
  SELECT {keys}, 'level' AS rule, 'text' AS path, score FROM detect_level WHERE flagged
  UNION ALL SELECT {keys}, 'axis', 'chart', score FROM detect_axis WHERE flagged
  UNION ALL SELECT {keys}, 'flat', 'text', score FROM detect_flat WHERE flagged
  UNION ALL SELECT {keys}, 'high', 'text', score FROM detect_high WHERE flagged
  UNION ALL SELECT {keys}, 'shape', 'text', score FROM detect_shape WHERE flagged)"""


def number(column: str) -> str:
    return f"coalesce(CAST(round(CAST(round({column}, 6) AS DECIMAL(38,6)), 2) AS VARCHAR), 'nan')"


def service_texts(part_values: int) -> str:
    head = "'Pod: ' || pod || chr(10) || 'Node: ' || node || chr(10)"
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY "timestamp", seq) - 1 AS spot FROM down),
chunks AS (
  SELECT {KEYS}, spot // {part_values} AS chunk, count(*) AS n,
         string_agg(spot || '    ' || coalesce(CAST(cpuusage AS VARCHAR), 'NaN'), chr(10) ORDER BY spot) AS lines
  FROM ranked GROUP BY ALL),
members AS (SELECT DISTINCT {KEYS} FROM samples),
blocks AS (
  SELECT {KEYS}, coalesce(chunk, 0) AS chunk, coalesce(n, 1) AS n, coalesce(lines, 'Series([], )') AS lines
  FROM members LEFT JOIN chunks USING ({KEYS})),
packed AS (
  SELECT *, CAST((sum(n) OVER (PARTITION BY service ORDER BY pod, node, chunk ROWS UNBOUNDED PRECEDING) - n) AS BIGINT)
            // {part_values} AS part
  FROM blocks),
stats AS (
  SELECT {KEYS}, avg(cpuusage) AS mean, max(cpuusage) AS max, min(cpuusage) AS min, stddev_samp(cpuusage) AS std
  FROM down GROUP BY ALL),
numbered AS (
  SELECT p.*, row_number() OVER (PARTITION BY service, part, pod, node ORDER BY chunk) AS nth,
         {head} || 'Mean: ' || {number('mean')} || ', Max: ' || {number('max')} || ', Min: ' || {number('min')}
                || ', Std: ' || {number('std')} || chr(10) || chr(10) AS stats_block,
         {head} || 'Data:' || chr(10) || lines || chr(10) || chr(10) AS values_block
  FROM packed p LEFT JOIN stats USING ({KEYS})),
whole AS (
  SELECT service, CAST(count(*) AS VARCHAR) AS n, avg(mean) AS mean, max(max) AS max, min(min) AS min, stddev_samp(mean) AS std
  FROM members LEFT JOIN stats USING ({KEYS}) GROUP BY service),
peers AS (
  SELECT service, CASE WHEN (SELECT max(part) FROM packed p WHERE p.service = whole.service) > 0 THEN
         'All ' || n || ' pods: mean of means ' || {number('mean')} || ', max ' || {number('max')} || ', min ' || {number('min')}
                || ', std of means ' || {number('std')} || chr(10) || chr(10) ELSE '' END AS peers
  FROM whole),
service_texts AS (
  SELECT service, part, CAST(count(*) FILTER (WHERE nth = 1) AS BIGINT) AS n_pods,
         'Statistics:' || chr(10) || any_value(peers) || string_agg(stats_block, '' ORDER BY pod, node) FILTER (WHERE nth = 1) AS stats_text,
         'Raw Data:' || chr(10) || string_agg(values_block, '' ORDER BY pod, node, chunk) AS values_text
  FROM numbered JOIN peers USING (service) GROUP BY service, part)"""


def filled(template: str, **columns: str) -> str:
    """SQL that puts columns in the places of a template."""
    out = text(template)
    for name, column in columns.items():
        out = out.replace("{" + name + "}", f"' || {column} || '")
    return out


def body(prompt: str) -> str:
    return (
        "CAST(to_json({'version': '1', 'max_tokens': 1000, 'messages': [{'role': 'user', 'content': "
        f"[{{'type': 'text', 'text': {prompt}}}]}}]}}) AS VARCHAR)"
    )


def pods_per_service(part_pods: int) -> str:
    return f"""WITH {SAMPLES}, members AS (SELECT DISTINCT {KEYS} FROM samples),
placed AS (SELECT *, (row_number() OVER (PARTITION BY service ORDER BY pod, node) - 1) // {part_pods} AS part FROM members)
SELECT service, part, count(*) AS n_pods,
       CAST(to_json(list({{'pod': pod, 'node': node}} ORDER BY pod, node)) AS VARCHAR) AS pods
FROM placed GROUP BY service, part"""


def log_parts(part_bytes: int) -> str:
    return f"""{LOGS}, sized AS (
  SELECT *, coalesce(message, '') || chr(10) AS line, strlen(coalesce(message, '') || chr(10)) AS size FROM logs),
running AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY region, log_group, log_stream ORDER BY event_time, seq
                                 ROWS UNBOUNDED PRECEDING) - size AS BIGINT) // {part_bytes} AS part
  FROM sized),
log_texts AS (
  SELECT region, log_group, log_stream, part, count(*) AS n_events, string_agg(line, '' ORDER BY event_time, seq) AS text
  FROM running GROUP BY region, log_group, log_stream, part)"""


def texts_from(columns: str, part_values: int = PART_VALUES) -> str:
    return f"WITH {SAMPLES}, {window(WEEK)}, {service_texts(part_values)} SELECT {columns} FROM service_texts"


def rules(scope: str, limits: Thresholds = Thresholds()) -> str:
    return f"WITH {SAMPLES}, {window(WEEK)}, {detector(scope, t=limits)}"


def all_oracles() -> dict[str, str]:
    samples = f"WITH {SAMPLES}"
    stats = (
        "round(avg(cpuusage), 6) AS mean, max(cpuusage) AS max, min(cpuusage) AS min, "
        "round(stddev_samp(cpuusage), 6) AS std"
    )
    upload = f"WITH {UPLOAD}, {window(WEEK, 'service, metric')}, {detector('window', 'service, metric')}"
    typed = f"""typed AS (
  SELECT event_type AS service, CASE WHEN event_id % 11 <> 0 THEN 'pod-' || (user_id % 15) END AS pod,
         'node-' || (user_id % 3) AS node, CASE WHEN event_id % 13 <> 0 THEN ts END AS "timestamp",
         CASE WHEN event_id % 7 <> 0 THEN value END AS cpuusage, event_id AS seq FROM events)"""
    found = {
        "log_stream_events": f"""WITH {LOGS},
first AS (SELECT DISTINCT region, log_group, log_stream FROM logs
          ORDER BY region <> 'us-east-1', region, log_group, log_stream LIMIT 1)
SELECT logs.* FROM logs JOIN first USING (region, log_group, log_stream)""",
        "log_catalog": f"WITH {LOGS} SELECT DISTINCT region, log_group, log_stream FROM logs",
        "notification_keys": """SELECT event_id AS notification_id, 'bucket-' || event_type AS bucket,
       'in/' || event_id || '.csv' AS "key" FROM events""",
        "notification_keys_every_record": """SELECT event_id AS notification_id, 'bucket-' || event_type AS bucket,
       'in/' || event_id || '.csv' AS "key" FROM events
UNION ALL SELECT event_id, 'bucket-' || event_type, 'in/' || user_id || '-b.csv' FROM events WHERE event_id % 4 = 0""",
        "response_text": f"WITH {ANSWERS} SELECT answer_id, service, path, coalesce(answer, '') AS answer FROM answers",
        "column_mapping": f"WITH {UPLOAD} SELECT metric, {KEYS}, \"timestamp\", round(cpuusage, 6) AS cpuusage, seq FROM samples",
        "typed_samples": f"WITH {typed} SELECT * FROM typed",
        "null_tokens": f"""WITH {typed} SELECT service, count(*) AS n_rows, count(*) FILTER (WHERE pod IS NULL) AS no_pod,
       count(*) FILTER (WHERE "timestamp" IS NULL) AS no_timestamp, count(*) FILTER (WHERE cpuusage IS NULL) AS no_cpuusage
FROM typed GROUP BY service""",
        "out_of_range": f"{samples} SELECT * FROM samples WHERE cpuusage IS NULL OR cpuusage NOT BETWEEN 0 AND 100",
        "preview": f"{samples} SELECT * FROM samples ORDER BY seq LIMIT 5",
        "group_sizes": f"""{samples} SELECT {KEYS}, count(*) AS n_rows, count(cpuusage) AS n_values,
       min("timestamp") AS first_time, max("timestamp") AS last_time FROM samples GROUP BY {KEYS}""",
        "group_stats": f"{samples} SELECT {KEYS}, {stats} FROM samples GROUP BY {KEYS}",
        "service_range": f"""{samples} SELECT service, min("timestamp") AS first_time, max("timestamp") AS last_time,
       round(date_diff('microsecond', min("timestamp"), max("timestamp")) / {HOUR}::DOUBLE, 6) AS span_hours
FROM samples GROUP BY service""",
        "pods_per_service": pods_per_service(PART_PODS),
        "pods_per_service_parts": pods_per_service(4),
        "stats_text": texts_from("service, part, n_pods, stats_text"),
        "values_text": texts_from("service, part, values_text"),
        "service_texts_parts": texts_from("*", SMALL_PART),
        "log_text": f"WITH {log_parts(PART_BYTES)} SELECT * FROM log_texts",
        "log_text_parts": f"WITH {log_parts(200)} SELECT * FROM log_texts",
        "prompt": texts_from(f"service, part, {filled(COMPARE_PODS, stats='stats_text', data='values_text')} AS prompt"),
        "requests": texts_from(
            f"service, part, 'text' AS path, {body(filled(COMPARE_PODS, stats='stats_text', data='values_text'))} AS body"
        ),
        "log_requests": f"""WITH {log_parts(PART_BYTES)}
SELECT region, log_group, log_stream, part, 'log' AS path, {body(filled(REVIEW_LOG, data='text'))} AS body FROM log_texts""",
        "image_requests": f"""SELECT 'page-' || page_id AS service, CAST(0 AS BIGINT) AS part, 'chart' AS path,
       '{{"version":"1","max_tokens":1000,"messages":[{{"role":"user","content":[{{"type":"text","text":'
       || CAST(to_json({text(COMPARE_LINES)}) AS VARCHAR)
       || '}},{{"type":"image","source":{{"type":"base64","media_type":"image/jpeg","data":"'
       || to_base64(encode(html)) || '"}}}}]}}]}}' AS body
FROM pages""",
        "b64_payload": "SELECT '/charts/cpu_usage_page-' || page_id || '.jpg' AS path, to_base64(encode(html)) AS payload FROM pages",
        "stub_inference": f"""WITH {SAMPLES}, {window(WEEK)}, {service_texts(SMALL_PART)}
SELECT service, part, min_by(pod, pod || ' ' || node) AS pod FROM numbered GROUP BY service, part""",
        "tag_first": f"WITH {ANSWERS} SELECT answer_id, result FROM parsed",
        "tag_first_pages": r"""SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
       '^\s+|\s+$', '', 'g') AS title FROM pages""",
        "tag_all": f"""WITH {ANSWERS} SELECT answer_id, CAST(unnest(range(len(pods))) AS BIGINT) AS nth, unnest(pods) AS pod
FROM parsed""",
        "tag_all_pages": r"""WITH found AS (SELECT page_id, regexp_extract_all(html, '(?s)<h\d+>(.*?)</h\d+>', 1) AS h FROM pages)
SELECT page_id, CAST(unnest(range(len(h))) AS BIGINT) AS nth,
       unnest([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN h]) AS heading FROM found""",
        "answers_flagged": f"""WITH {ANSWERS} SELECT answer_id, service, path, result,
       NOT contains(result, '{NO_ANOMALY}') AS flagged, coalesce(array_to_string(pods, '|'), '') AS pods FROM parsed""",
        "answer_anomalies": f"WITH {ANSWERS} SELECT DISTINCT service, pod FROM named",
        "known_answer_anomalies": f"""WITH {SAMPLES}, {ANSWERS} SELECT DISTINCT service, pod FROM named n
WHERE EXISTS (SELECT 1 FROM samples s WHERE s.service = n.service AND n.pod IN (s.pod, s.pod || '-' || s.node))""",
        "anomalies": f"{rules('window')} SELECT DISTINCT service, pod FROM findings",
        "anomalies_full": f"{rules('full')} SELECT DISTINCT service, pod FROM findings",
        "findings": f"{rules('window')} SELECT {KEYS}, rule, path, round(score, 6) AS score FROM findings",
        "findings_full": f"{rules('full')} SELECT {KEYS}, rule, path, round(score, 6) AS score FROM findings",
        "findings_series_table": f"{rules('full', KEEN)} SELECT {KEYS}, rule, path, round(score, 6) AS score FROM findings",
        "all_normal": f"{rules('window')} SELECT count(*) = 0 AS all_normal FROM findings",
        "report_lines": f"""{rules('window')} SELECT DISTINCT service, pod, CAST(NULL AS VARCHAR) AS message FROM findings
UNION ALL SELECT NULL, NULL, '{ALL_NORMAL_MESSAGE}' FROM (SELECT count(*) AS n FROM findings) WHERE n = 0""",
        "report_lines_flat": f"""{rules('full')}, flat AS (SELECT * FROM findings WHERE rule = 'flat')
SELECT DISTINCT service, pod, CAST(NULL AS VARCHAR) AS message FROM flat
UNION ALL SELECT NULL, NULL, '{ALL_NORMAL_MESSAGE}' FROM (SELECT count(*) AS n FROM flat) WHERE n = 0""",
        "status": f"""{rules('window')} SELECT CAST(200 AS INTEGER) AS "statusCode",
       '{{"message":"Analysis completed successfully","all_normal":' || CAST(count(*) = 0 AS VARCHAR) || '}}' AS body
FROM findings""",
        "anomalous_series": f"""{rules('window')} SELECT service, pod || '-' || node AS label, "timestamp", cpuusage AS value
FROM down WHERE service IN (SELECT service FROM findings)""",
        "flagged_pods": f"""{rules('window')},
verdicts AS (SELECT {KEYS}, count(*) AS n_rules, string_agg(rule, ',' ORDER BY rule) AS rules FROM findings GROUP BY ALL),
stats AS (SELECT {KEYS}, {stats} FROM samples GROUP BY {KEYS})
SELECT {KEYS}, mean, max, min, std, coalesce(n_rules, 0) AS n_rules, rules FROM stats LEFT JOIN verdicts USING ({KEYS})""",
        "upload_analysis": f"{upload} SELECT service, metric, pod, node, rule, path, round(score, 6) AS score FROM findings",
        "upload_chart_data": f"""{upload} SELECT service, metric, pod || '-' || node AS label, "timestamp", round(cpuusage, 6) AS value FROM down""",
        "results_json": f"""{upload}, said AS (SELECT service, metric, pod || '-' || node || ': ' || rule AS analysis FROM findings),
groups AS (SELECT DISTINCT service, metric FROM samples)
SELECT '{{"group":"' || service || ' / ' || metric || '","analysis":"' || coalesce(analysis, '{NO_ANOMALY}') || '"}}' AS result
FROM groups LEFT JOIN said USING (service, metric)""",
    }
    two = "CAST(round(CAST(round({}, 6) AS DECIMAL(38, 6)), 2) AS DECIMAL(38, 2))"
    in_files = """texts AS (
  SELECT event_type AS service, CASE WHEN event_id % 11 <> 0 THEN 'pod-' || (user_id % 15) END AS pod,
         'node-' || (user_id % 3) AS node, CASE WHEN event_id % 13 <> 0 THEN ts END AS "timestamp",
         CASE WHEN event_id % 7 <> 0 THEN value END AS cpuusage, row_number() OVER (ORDER BY event_id) - 1 AS seq, event_id FROM events)"""
    late, much = "event_id % 17 = 0", "event_id % 19 = 0"
    found |= {
        # in whatever parts a service is shown, all its pods are judged against the figures of all
        "compare_tree": f"""WITH {SAMPLES}, {window(WEEK)},
members AS (SELECT DISTINCT {KEYS} FROM samples),
stats AS (SELECT {KEYS}, avg(cpuusage) AS mean FROM members LEFT JOIN down USING ({KEYS}) GROUP BY {KEYS}),
peers AS (SELECT service, {two.format('avg(mean)')} AS middle, {two.format('stddev_samp(mean)')} AS spread FROM stats GROUP BY service)
SELECT service, pod || '-' || node AS pod FROM stats JOIN peers USING (service) WHERE abs({two.format('mean')} - middle) > spread""",
        "review_tree": f"WITH {LOGS} SELECT region, log_group, log_stream, count(*) AS n_events FROM logs GROUP BY ALL",
        "resumed_inference": f"""WITH {SAMPLES}, {window(WEEK)}, {service_texts(10 * TINY_PART)}
SELECT service, part, CASE WHEN contains(values_text, 'Pod: pod-1' || chr(10)) THEN 'second' ELSE 'first' END AS answer, CAST(NULL AS VARCHAR) AS error
FROM service_texts""",
        "csv_samples": f"WITH {in_files} SELECT * EXCLUDE (event_id) REPLACE (round(cpuusage, 6) AS cpuusage) FROM texts",
        "file_preview": """SELECT event_type AS service,
  CASE WHEN event_id % 11 = 0 THEN nullif(['NA', '', 'null', 'NaN', '<NA>'][event_id % 5 + 1], '') ELSE 'pod-' || (user_id % 15) END AS pod,
  'node-' || (user_id % 3) AS node,
  CASE WHEN event_id % 13 = 0 THEN nullif(['NA', '', 'null', 'NaN', '<NA>'][event_id % 5 + 1], '') ELSE rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') END AS "timestamp",
  CASE WHEN event_id % 7 = 0 THEN nullif(['NA', '', 'null', 'NaN', '<NA>'][event_id % 5 + 1], '') ELSE CAST(value AS VARCHAR) END AS cpuusage
FROM events ORDER BY event_id LIMIT 5""",
        "values_text_by_row": f"""WITH {in_files},
blocks AS (SELECT service, pod, node, 'Pod: ' || pod || chr(10) || 'Node: ' || node || chr(10) || 'Data:' || chr(10)
  || string_agg(seq || '    ' || coalesce(CAST(cpuusage AS VARCHAR), 'NaN'), chr(10) ORDER BY "timestamp", seq) || chr(10) || chr(10) AS block
  FROM texts WHERE pod IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY service, pod, node)
SELECT service, CAST(0 AS BIGINT) AS part, 'Raw Data:' || chr(10) || string_agg(block, '' ORDER BY pod, node) AS values_text FROM blocks GROUP BY service""",
        "refused_rows": f"""WITH {in_files} SELECT service, pod, node,
  CASE WHEN {late} THEN 'yesterday' WHEN event_id % 13 <> 0 THEN rtrim(rtrim(strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') END AS time_text,
  CASE WHEN {much} THEN 'much' ELSE CAST(cpuusage AS VARCHAR) END AS value_text, seq,
  CASE WHEN {late} THEN 'timestamp' ELSE 'cpuusage' END AS reason FROM texts WHERE {late} OR {much}""",
        "accepted_rows": f"WITH {in_files} SELECT * EXCLUDE (event_id) REPLACE (round(cpuusage, 6) AS cpuusage) FROM texts WHERE NOT ({late} OR {much})",
        "noticed_files": """WITH kinds AS (SELECT DISTINCT event_type AS kind FROM events UNION SELECT 'empty')
SELECT kind, CAST(CASE kind WHEN 'empty' THEN 500 ELSE 200 END AS INTEGER) AS "statusCode",
  CASE WHEN row_number() OVER (ORDER BY kind) = 2 THEN 2 ELSE 1 END::BIGINT AS n_runs FROM kinds""",
    }
    found["stored_window_cut"] = f"WITH {SAMPLES}, {window(WEEK)} SELECT * REPLACE (round(cpuusage, 6) AS cpuusage) FROM cut"
    found["stored_log_events"] = found["log_stream_events"]
    for suffix, hours in (("", 8), ("_168h", WEEK)):
        windowed = f"WITH {SAMPLES}, {window(hours)}"
        found |= {
            f"service_window{suffix}": f"{windowed} SELECT * FROM windows",
            f"window_cut{suffix}": f"{windowed} SELECT * FROM cut",
            f"downsampled{suffix}": f"{windowed} SELECT * FROM down",
            f"window_stats{suffix}": f"""{windowed}, members AS (SELECT DISTINCT {KEYS} FROM samples)
SELECT {KEYS}, count(seq) AS n_rows, {stats} FROM members LEFT JOIN down USING ({KEYS}) GROUP BY {KEYS}""",
            f"chart_series{suffix}": f"""{windowed} SELECT service, pod || '-' || node AS label, "timestamp",
       cpuusage AS value FROM down""",
            f"chart_ticks{suffix}": f"""{windowed},
ticks AS (SELECT service, unnest(generate_series(window_start, window_end, INTERVAL 15 MINUTE)) AS tick FROM windows)
SELECT service, tick, strftime(tick, '%Y-%m-%d %H:%M') AS tick_label FROM ticks""",
            f"chart_meta{suffix}": f"""{windowed} SELECT service, 'CPU Usage Over Time - ' || service || chr(10)
       || '({hours}-hour window with downsampled data)' AS title, 'Time' AS x_label, 'CPU Usage (%)' AS y_label,
       'cpu_usage_' || service AS object_name, 'output/anomalies/cpu_usage_' || service AS object_key FROM windows""",
        }
    for suffix, scope in (("", "window"), ("_full", "full")):
        found[f"despiked{suffix}"] = f"{rules(scope)} SELECT {KEYS}, seq, cpuusage, round(smooth, 6) AS smooth FROM smoothed"
        for rule in ("level", "axis", "flat", "high", "shape"):
            found[f"detect_{rule}{suffix}"] = (
                f"{rules(scope)} SELECT {KEYS}, round(score, 6) AS score, flagged FROM detect_{rule}"
            )
    return found
