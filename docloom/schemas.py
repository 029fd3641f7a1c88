"""Spark schemas of the document-capture tables, as DDL."""

from __future__ import annotations

BBOX = "struct<left:double,top:double,right:double,bottom:double>"
POINT = "struct<x:double,y:double>"
_TEXT = f"text:string,boundingBox:{BBOX},cornerPoints:array<{POINT}>"
ELEMENT = f"struct<{_TEXT}>"
LINE = f"struct<{_TEXT},elements:array<{ELEMENT}>>"
BLOCK = f"struct<{_TEXT},lines:array<{LINE}>>"
SCAN = f"scan_id bigint, text string, blocks array<{BLOCK}>"

_TEMPLATE_BLOCKS = f"blocks:array<struct<text:string,blockType:string,boundingBox:{BBOX}>>"
RULE = (
    "struct<patterns:array<string>,"
    "validation:struct<minWords:int,maxWords:int,minLength:int,maxLength:int,length:int,allowedValues:array<string>,mustContain:array<string>>,"
    "postProcess:struct<removeNoiseWords:array<string>,capitalizeEachWord:boolean,format:string,convertEightDigits:boolean,normalize:map<string,string>,standardize:string,"
    "cleanText:boolean,removeExtraSpaces:boolean,removeSpaces:boolean>,"
    "confidenceScoring:struct<baseScore:double,patternMatchBonus:double,validationPassBonus:double,wordCountBonus:map<string,double>,digitCountBonus:map<string,double>,"
    "formatMatchBonus:double,exactMatchBonus:double,keywordMatchBonus:double,lengthBonus:double,dateFormatBonus:double,allCapsBonus:double,commaBonus:double>,"
    "extractionStrategy:struct<type:string,combineGroups:string,groupSeparator:string,fallbackToFullMatch:boolean,fallbackToDigitsOnly:boolean,formatLength:int,cleanAlphabetic:boolean>>"
)
TEMPLATE = f"struct<{_TEMPLATE_BLOCKS},format:string,formatId:int,textRecognition:struct<{_TEMPLATE_BLOCKS},format:string,formatId:int>,extractionRules:map<string,{RULE}>>"
QUAD = f"array<{POINT}>"
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
