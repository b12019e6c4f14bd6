"""Model requests and responses as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwatch.fixed_values import MAX_ANSWER_TOKENS

# The task as given to the model. Callers may pass wording of their own with the same two places.
COMPARE_PODS = """You look after a fleet of services. Below are statistics and values of the CPU usage of all pods of one service.
Name the pods that behave unlike the others:
- the pattern of use clearly differs from the other pods, or the line is dead flat, or the load stays high for a long time;
- the mean lies away from the means of most pods.
Short spikes and dips do not count. Give names only, no reasons and no advice.
Without such pods answer <result>无异常</result>, otherwise
<result><pod1>name</pod1><pod2>name</pod2></result>
Where a line about all pods is given, judge each pod against it.

{stats}
{data}
"""

COMPARE_LINES = """The picture shows the CPU usage of all pods of one service, one line per pod.
Name the pods whose line behaves unlike the others: another pattern, dead flat, high for a long time, or a level that,
seen against the range of the vertical axis, lies away from most lines. Short spikes and dips do not count.
Give names only. Without such pods answer <result>无异常</result>, otherwise
<result><pod1>name</pod1><pod2>name</pod2></result>
"""

REVIEW_LOG = """Read the log below as a security analyst. Say what it shows and which alert rules would have helped. Answer in Chinese.

{data}"""

MERGE_REVIEWS = """The notes below were made about the parts of one log, in order. Put them together into one review of the whole log,
in the same form, without repeating what several of them say. Answer in Chinese.

{answers}"""


def request_body(
    text: Column,
    image: Column | None = None,
    media_type: str = "image/jpeg",
    version_field: str = "version",
    version: str = "1",
    max_tokens: int = MAX_ANSWER_TOKENS,
) -> Column:
    """One user message with a text and, where given, an image in base64."""
    content = [F.struct(F.lit("text").alias("type"), text.alias("text"))]
    if image is not None:
        source = F.struct(F.lit("base64").alias("type"), F.lit(media_type).alias("media_type"), image.alias("data"))
        source_type = "struct<type:string,media_type:string,data:string>"
        content = [
            F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast(source_type).alias("source")),
            F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), source.alias("source")),
        ]
    message = F.struct(F.lit("user").alias("role"), F.array(*content).alias("content"))
    return F.to_json(
        F.struct(F.lit(version).alias(version_field), F.lit(max_tokens).alias("max_tokens"), F.array(message).alias("messages"))
    )


def response_text(body: Column | str) -> Column:
    """The answer inside a response body."""
    return F.get_json_object(body, "$.content[0].text")
