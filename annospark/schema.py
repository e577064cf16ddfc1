"""The canonical record, as DDL."""

from __future__ import annotations

MASK = "struct<h:int,w:int,counts:array<int>>"
TURN = "struct<role:string,value:string,boxes_seq:array<array<int>>,masks_seq:array<array<int>>,points_seq:array<array<int>>,keypoints_seq:array<array<int>>>"
SYSTEM = "struct<task_name:string,element:array<string>,use_unit:boolean,unit:array<string>>"
TARGET = f"struct<boxes:array<array<double>>,points:array<array<double>>,masks:array<{MASK}>,keypoints:array<array<array<double>>>,depth:array<string>>"
SAMPLE = f"sample_id string, source string, image struct<path:string,width:int,height:int>, target {TARGET}, system array<{SYSTEM}>, turns array<{TURN}>"
