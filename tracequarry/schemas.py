"""Fixed envelopes of trace tables, as DDL; dynamic content stays JSON text."""

from __future__ import annotations

EVENTS = (
    "event_id string, episode_id string, source_id string, pos int, actor string, kind string, content string, content_is_json boolean, ts timestamp, raw_timestamp string, call_id string, tool_call_id string, parent_event_id string, batch_size int, name string"
)
BENCH_ROWS = "task string, id string, prompt array<string>, response array<string>, current_prompt string, system_str string, turn_idx int, total_turns int, benchmark_task string, source string, env_id string, split string, probe string, generated_shapes array<string>, gen string"
ATIF = (
    "schema_version string, session_id string, agent struct<name:string,version:string,model_name:string>, continued_trajectory_ref string, "
    "steps array<struct<step_id:int,timestamp:string,source:string,message:string,is_copied_context:boolean,tool_calls:array<struct<tool_call_id:string,function_name:string,arguments:struct<keystrokes:string,duration:double>>>,"
    "observation:struct<results:array<struct<source_call_id:string,content:string>>>,metrics:struct<prompt_tokens:long,completion_tokens:long,cached_tokens:long,cost_usd:double>>>"
)
MCP_MESSAGES = "array<struct<type:string,role:string,call_id:string,name:string,arguments:string,output:string,content:string,text:string>>"
CHAT_MESSAGES = "array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"
ROLLOUT = (
    "env_id string, task_id string, reward double, label string, checklist_pass int, checklist_total int, terminated boolean, truncated boolean, init_state string, final_state string, "
    "trajectory array<struct<step:int,action:struct<name:string,arguments:string>,observation:string,observation_raw:string,error:string,state_before:string,state_after:string,state_diff:string,n_delta:int,obs_success:boolean,sigma_t:string>>"
)
CALL_LOG = "role string, cache_hit boolean, error string, elapsed_s double, system string, user string, usage struct<prompt_tokens:long,cached_tokens:long,completion_tokens:long>"
EVIDENCE = (
    "id string, episode_id string, transition_id string, action struct<type:string,arguments:string>, outcome string, confidence double, "
    "preconditions array<struct<subject:string,predicate:string,value:string,status:string>>, observation_facts array<struct<subject:string,predicate:string,value:string,status:string>>, "
    "mutations array<struct<op:string,path:string,value:string,delay_steps:int>>, observation_text string, ambiguities array<string>, provenance array<struct<source_id:string,episode_id:string,event_ids:array<string>>>"
)
