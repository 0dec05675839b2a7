"""Row types of the engine's relations."""

CHUNK = "struct<id:string,text:string,section_name:string,section_number:string,chunk_index:int,page_number:int,file_path:string>"
CODE = (
    "classes array<struct<name:string,line:int,bases:array<string>,methods:array<string>>>,"
    "imports array<struct<module:string,names:array<string>,type:string,line:int>>,"
    "functions array<struct<name:string,line:int,parameters:array<struct<name:string,type:string>>,in_class:string>>,"
    "assignments array<struct<line:int,target:string,value_type:string,value:string>>,"
    "function_calls array<struct<line:int,function:string,args:array<string>>>,"
    "error string"
)
MODEL = (
    "project_name string, project_metadata struct<version:string,generated_at:string,description:string>, "
    "bounded_contexts array<struct<context_name:string,description:string,allowed_dependencies:array<string>,"
    "ubiquitous_language:struct<entities:array<struct<name:string,description:string,synonyms_to_avoid:array<string>>>,"
    "value_objects:array<struct<name:string,attributes:array<string>,description:string>>,domain_events:array<string>>>>, "
    "global_rules struct<naming_convention:string,banned_global_terms:array<string>>"
)
CALLS = "timestamp string, stage string, operation string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
VALIDATIONS = "timestamp string, filename string, file_size_chars bigint, code_file_tokens bigint, validation_time_ms double, violations_count bigint, violation_types array<string>, has_sources boolean"
RETRIEVAL_TESTS = "test_cases array<struct<id:int,violation_type:string,message:string,expected_section:string>>"
