"""Schemas of the record kinds, as Spark DDL."""

CALL_FUNCTION = "struct<name:string,arguments:string>"
TOOL_CALL = f"struct<id:string,type:string,function:{CALL_FUNCTION}>"
MESSAGE = (
    "struct<role:string,content:string,"
    "parts:array<struct<type:string,text:string,image_url:struct<url:string,detail:string>>>,"
    f"name:string,tool_call_id:string,tool_calls:array<{TOOL_CALL}>,function_call:{CALL_FUNCTION}>"
)
REQUEST = (
    "request_id string, model string, stream boolean, max_tokens int, temperature double, top_p double, "
    "top_k int, min_p double, typical_p double, presence_penalty double, frequency_penalty double, "
    "repeat_penalty double, tfs_z double, mirostat_mode int, mirostat_tau double, mirostat_eta double, "
    "seed int, stop array<string>, logit_bias map<int,double>, logprobs boolean, top_logprobs int, "
    f"messages array<{MESSAGE}>, "
    "tools array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>, "
    "tool_choice struct<mode:string,function_name:string>, "
    "functions array<struct<name:string,description:string,parameters:string>>, "
    "function_call struct<mode:string,name:string>, response_format struct<type:string,schema:string>"
)
# The same request as it arrives: fields that may be text or a structure are variants.
_RAW_MESSAGE = (
    "struct<role:string,content:variant,name:string,tool_call_id:string,"
    f"tool_calls:array<{TOOL_CALL}>,function_call:{CALL_FUNCTION}>"
)
RAW_REQUEST = (
    "request_id string, model string, stream boolean, max_tokens int, temperature double, top_p double, "
    "top_k int, min_p double, typical_p double, presence_penalty double, frequency_penalty double, "
    "repeat_penalty double, tfs_z double, mirostat_mode int, mirostat_tau double, mirostat_eta double, "
    "seed int, stop variant, logit_bias variant, logprobs boolean, top_logprobs int, "
    f"messages array<{_RAW_MESSAGE}>, "
    "tools array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>, "
    "tool_choice variant, functions array<struct<name:string,description:string,parameters:string>>, "
    "function_call variant, response_format struct<type:string,schema:string>, _corrupt string"
)
CHOICE_MESSAGE = (
    f"struct<role:string,content:string,reasoning_content:string,tool_calls:array<{TOOL_CALL}>>"
)
CHOICE = f"struct<index:int,message:{CHOICE_MESSAGE},logprobs:string,finish_reason:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
COMPLETION = (
    f"id string, object string, created bigint, model string, choices array<{CHOICE}>, usage {USAGE}"
)
DELTA_CALL = f"struct<index:int,id:string,type:string,function:{CALL_FUNCTION}>"
DELTA = f"struct<role:string,content:string,reasoning_content:string,tool_calls:array<{DELTA_CALL}>>"
CHUNK_CHOICE = f"struct<index:int,delta:{DELTA},logprobs:string,finish_reason:string>"
CHUNK_BODY = (
    f"struct<id:string,object:string,created:bigint,model:string,choices:array<{CHUNK_CHOICE}>>"
)
CHUNK = (
    "stream_id string, seq bigint, ts timestamp, id string, object string, created bigint, model string, "
    f"choices array<{CHUNK_CHOICE}>"
)
EMBEDDING_REQUEST = "request_id string, input variant, model string, _corrupt string"
SPAN = (
    "span_id string, trace_id string, parent_id string, name string, start_ns bigint, end_ns bigint, "
    "status_code string, status_description string, model string, streaming boolean, max_tokens int, "
    "temperature double, input_messages int, input_content_length bigint, input_count int, "
    "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, output_content_length bigint, "
    "chunk_count bigint, output_count int, finish_reason string, force_sample boolean"
)
SPAN_EVENT = (
    "span_id string, seq bigint, name string, ts_ns bigint, chunk_size bigint, "
    "chunk_content_size bigint, finish_reason string"
)
MODEL = "id string, object string, created bigint, owned_by string"
