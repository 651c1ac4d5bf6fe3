"""Result types. Positions are 0-based UTF-16 units, as in the text's 16-bit form."""

from __future__ import annotations

REMOVED = "struct<type:string,position:int,length:int,description:string>"
MATCH = "struct<vendor:string,pattern:string,confidence:double,position:int,length:int>"
HYGIENE = f"struct<cleaned:string,removed:array<{REMOVED}>,confidence:double>"
TEXT_CLEAN = f"struct<cleaned:string,removed:array<{REMOVED}>,detections:array<{MATCH}>,confidence:double>"
ARTIFACT = "struct<type:string,description:string,line:int,column:int>"
MARKDOWN_CLEAN = f"struct<cleaned:string,removed:array<{REMOVED}>,artifacts:array<{ARTIFACT}>,code_blocks_found:int,code_blocks_preserved:int,frontmatter_removed:boolean>"
SEGMENT = "struct<seg:int,kind:string,fence:string,closing:string,lines:array<string>>"
ENTRY = "struct<container:string,key:string,value:string>"
FILE_CLEAN = f"struct<content:binary,removed:array<{ENTRY}>,input_bytes:long,output_bytes:long,error_code:string,error_message:string>"
INSPECTED = f"struct<entries:array<{ENTRY}>,error_code:string,error_message:string>"
REGION = "struct<x:int,y:int,width:int,height:int,confidence:double>"
