"""Registered queries: ordered computations on events, conversations and orders."""

from pyspark.sql import functions as F

from ..functions.seeded import unit
from ..operators import ordered as od
from . import base as b
from .registry import query


@query("w1_numbering", "select event_type, count(*) as n, row_number() over (order by count(*) desc, event_type) as label_id from events group by event_type")
def w1_numbering(t):
    from ..operators.vocab import frequency_ids

    return frequency_ids(t.events, "event_type", "n", "label_id")


@query(
    "w2_top_k",
    "select user_id, event_id, rk from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rk from events) where rk <= 3",
)
def w2_top_k(t):
    rows = t.events.select("user_id", "event_id", "value")
    return od.ranked_by_score(rows, ["user_id"], [F.desc("value"), "event_id"], 3, "rk").select("user_id", "event_id", "rk")


@query("w3_arg_max", "select user_id, arg_max(event_id, {'v': value, 'e': -event_id}) as best from events group by user_id")
def w3_arg_max(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


def labelled_events(t):
    gold = F.when(F.col("event_type") == "error", -1).otherwise(F.floor("value").cast("int") % 3)
    wrong = unit(4, "pred", "event_id") < 0.05
    return t.events.select("user_id", "event_id", gold.alias("label")).withColumn("pred", F.when(wrong, F.col("label") + 1).otherwise(F.col("label")))


b.add_cte(
    "labelled_events",
    f"""select user_id, event_id, label, case when {b.u_sql(4, 'pred', 'event_id')} < 0.05 then label + 1 else label end as pred
    from (select user_id, event_id, case when event_type = 'error' then -1 else floor(value)::int % 3 end as label from events)""",
)
_W4 = """select user_id, event_id, sum(case when label != -1 and pred != label then 1 else 0 end)
   over (partition by user_id order by event_id) = 0 as prefix_right from labelled_events"""


@query("w4_prefix_right", b.using("labelled_events") + _W4)
def w4_prefix_right(t):
    from ..operators.labelscore import prefix_right

    return prefix_right(labelled_events(t), ["user_id"], "event_id").select("user_id", "event_id", "prefix_right")


@query(
    "e7_label_accuracy",
    b.using("labelled_events") + f""", p as ({_W4}) select avg(prefix_right::int) as by_position,
    (select avg(ok) from (select (bool_and(prefix_right))::int as ok from p group by user_id)) as by_example from p""",
)
def e7_label_accuracy(t):
    from ..operators.labelscore import label_accuracy

    return label_accuracy(labelled_events(t), ["user_id"], "event_id")


@query(
    "w5_carry_marker",
    """select user_id, event_id, max(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id) as start from events""",
)
def w5_carry_marker(t):
    marker = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return od.carried_marker(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", marker, "start").select("user_id", "event_id", "start")


@query(
    "w6_next_line",
    """select * from (select conv_id, turn, md5(text) as line, md5(lead(text) over (partition by conv_id order by turn)) as next
       from conversations) where next is not null""",
)
def w6_next_line(t):
    out = od.next_line(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", "after")
    return out.select("conv_id", "turn", F.md5("text").alias("line"), F.md5("after").alias("next"))


@query(
    "w7_document_number",
    """select user_id, event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id)::bigint as doc from events""",
)
def w7_document_number(t):
    is_blank = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return od.running_total(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", is_blank, "doc").select("user_id", "event_id", "doc")


@query("w8_number_in_group", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as no from orders")
def w8_number_in_group(t):
    return od.running_number(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "no")


@query(
    "w9_merge_beams",
    """select user_id, event_id, side, place from (select *, row_number() over (partition by user_id, side order by value desc, event_id) as place from (
         select *, row_number() over (partition by user_id order by value desc, event_id) as rk from (
           select user_id, event_id, value, case when event_type = 'click' then 'open' else 'done' end as side from events)) where rk <= 4)""",
)
def w9_merge_beams(t):
    from ..operators.ranking import merge_beams

    side = t.events.select("user_id", "event_id", F.col("value").alias("score"), "event_type")
    opened = side.filter("event_type = 'click'").drop("event_type")
    done = side.filter("event_type != 'click'").drop("event_type")
    return merge_beams(opened, done, "user_id", "event_id", 4).select("user_id", "event_id", "side", "place")


@query(
    "o6_likely_columns",
    """select user_id, array_to_string(list_sort(list(event_id order by value desc, event_id)[1:3])::varchar[], ',') as picked from events group by user_id""",
)
def o6_likely_columns(t):
    from ..operators.ranking import likely_in_order

    return likely_in_order(t.events.select("user_id", "event_id", F.col("value").alias("score")), "user_id", "event_id", 3, "picked")
