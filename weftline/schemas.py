"""Record types of extracted pages."""

HEADING = "struct<level:int,text:string,importance:double>"
LINK = "struct<text:string,href:string,rel:string,title:string>"
IMAGE = "struct<src:string,alt:string,title:string,width:string,height:string,loading:string>"
TABLE = "struct<index:int,headers:array<string>,rows:array<array<string>>>"
LIST = "struct<type:string,items:array<string>>"
FIELD = "struct<tag:string,type:string,name:string,id:string,placeholder:string,required:boolean>"
FORM = f"struct<action:string,method:string,id:string,type:string,fields:array<{FIELD}>>"
ZONE = "struct<text:string,links:array<struct<text:string,href:string>>>"
META = "struct<name:string,property:string,http_equiv:string,charset:string,content:string,lang:string>"
ENTITIES = "struct<organization:string,phones:array<string>,emails:array<string>,addresses:array<string>>"
SEGMENT = "struct<field:string,content:string,weight:double>"
MATCH = "struct<tag:string,text:string,attrs:map<string,string>>"

PAGE_FIELDS = {
    "title": "string",
    "meta": f"array<{META}>",
    "headings": f"array<{HEADING}>",
    "paragraphs": "array<string>",
    "main_content": "string",
    "links": f"array<{LINK}>",
    "images": f"array<{IMAGE}>",
    "tables": f"array<{TABLE}>",
    "lists": f"array<{LIST}>",
    "forms": f"array<{FORM}>",
    "json_ld": "array<string>",
    "opengraph": "map<string,string>",
    "zones": f"map<string,{ZONE}>",
    "entities": ENTITIES,
    "segments": f"array<{SEGMENT}>",
}
