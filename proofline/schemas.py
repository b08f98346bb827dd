"""Tables of the engine."""

APPLICATION = (
    "application_id string, ttb_id string, beverage_type string, brand_name string, class_type string, alcohol_content string, net_contents string, "
    "bottler_name string, label_company_name string, country_of_origin string, is_import boolean"
)
READING = "struct<text:string,confidence:double>"
TEXT_FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler_name", "country_of_origin")
BOUNDS = "struct<x:double,y:double,width:double,height:double>"
APPEARANCE = "struct<measured_contrast:double,relative_contrast:double,text_color_hex:string,background_color_hex:string>"
WARNING = f"struct<text:string,confidence:double,header_is_all_caps:boolean,header_is_bold:boolean,legible_size:boolean,bounds:{BOUNDS},appearance:{APPEARANCE}>"
QUALITY = "struct<score:double,issues:array<string>,too_poor_to_review:boolean>"
LEGIBILITY = "struct<score:double,below_ordinary_eyesight:boolean,issues:array<string>>"
EXTRACTION = ", ".join(f"{f} {READING}" for f in TEXT_FIELDS) + f", government_warning {WARNING}, image_quality {QUALITY}, label_legibility {LEGIBILITY}, notes array<string>, extraction_ms long, reader string"
CHECK = "struct<id:string,name:string,category:string,verdict:string,expected:string,found:string,rule:string,explanation:string,citation:string,confidence:double>"
