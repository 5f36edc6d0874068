"""Schemas of the catalog, normalised; nesting happens when pages are rendered."""

from __future__ import annotations

from pyspark.sql import types as T

REFERENCE = "struct<display_name:string,uid:string>"
ATTRIBUTE = "struct<display_name:string,uid:string,constructor_uid:string,arguments:array<struct<name:string,value:string>>>"
ENTRY = "struct<name:string,value:string>"
DOCUMENTATION = f"struct<summary:string,remarks:string,returns:string,value:string,examples:array<string>,parameters:array<{ENTRY}>,type_parameters:array<{ENTRY}>,exceptions:array<{ENTRY}>,see_also:array<string>,inherited_from:string>"
PARAMETER = f"struct<name:string,type:{REFERENCE},is_optional:boolean,is_params:boolean,is_in:boolean,is_out:boolean,is_ref:boolean,default_value:string>"
MEMBER = (
    "struct<uid:string,name:string,kind:string,accessibility:string,is_static:boolean,is_extension:boolean,is_required:boolean,is_virtual:boolean,is_override:boolean,"
    f"is_abstract:boolean,is_sealed:boolean,signature:string,parameters:array<{PARAMETER}>,type_parameters:array<string>,return_type:{REFERENCE},documentation:{DOCUMENTATION},"
    f"source_url:string,is_obsolete:boolean,obsolete_message:string,attributes:array<{ATTRIBUTE}>>"
)
TYPES = (
    "uid string, tfm string, name string, full_name string, namespace string, arity int, type_kind string, object_kind string, is_static boolean, is_sealed boolean, "
    f"is_abstract boolean, is_readonly boolean, is_byref_like boolean, assembly_name string, base {REFERENCE}, interfaces array<{REFERENCE}>, source_url string, "
    f"is_obsolete boolean, obsolete_message string, type_parameters array<string>, documentation {DOCUMENTATION}, attributes array<{ATTRIBUTE}>, members array<{MEMBER}>, "
    f"extension_blocks array<struct<receiver_name:string,receiver:{REFERENCE},members:array<{MEMBER}>>>, values array<struct<name:string,uid:string,value:string,documentation:{DOCUMENTATION},source_url:string>>, "
    f"cases array<{REFERENCE}>, invoke struct<signature:string,parameters:array<{PARAMETER}>,return_type:{REFERENCE}>, forwarded boolean"
)
MANIFEST = (
    "nugetPackageOwners array<string>, tfmPreference array<string>, additionalPackages array<struct<id:string,version:string>>, excludePackages array<string>, "
    "excludePackagePrefixes array<string>, referencePackages array<struct<id:string,version:string,targetTfm:string,pathPrefix:string>>, tfmOverrides map<string,string>"
)


def types_schema() -> T.StructType:
    return T.StructType.fromDDL(TYPES)
