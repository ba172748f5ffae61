"""Keyword signatures of document types: fixed values, in the order in which equal confidences count: (type, terms that must all occur, confidence)."""

from __future__ import annotations


# Types whose signatures are too general for a text.
NOT_IN_TEXT = [
    "approved_execution_project", "bill_of_quantities", "construction_organization_plan", "construction_permit", "construction_permit_conformity_declaration", "contract_and_related_acts", "development_permit",
    "geological_engineering_study", "professional_license", "seismic_study", "supervisor_contract", "technical_declaration", "technical_opposition", "topographic_documentation",
]
# What a text says.
TEXT = [
    ("foundation_completion_and_level_0_00_control_act", ["akt kontroll", "theme", "0.00"], 0.92),
    ("foundation_completion_and_level_0_00_control_act", ["akt kontroll", "theme", "+0.00"], 0.92),
    ("foundation_completion_and_level_0_00_control_act", ["akt kontroll", "perfundim", "theme"], 0.89),
    ("foundation_completion_and_level_0_00_control_act", ["proces verbal", "theme", "0.00"], 0.86),
    ("level_0_00_control_act", ["akt kontroll", "0.00"], 0.9),
    ("level_0_00_control_act", ["aktkontroll", "0.00"], 0.9),
    ("structural_frame_completion_control_act", ["akt kontroll", "karabina"], 0.9),
    ("structural_frame_completion_control_act", ["akt kontroll", "struktur"], 0.88),
    ("facade_and_finishing_completion_control_act", ["akt kontroll", "fasad", "rifinitur"], 0.9),
    ("external_system_completion_control_act", ["akt kontroll", "rrjet", "jasht"], 0.9),
    ("external_system_completion_control_act", ["akt kontroll", "sistem", "jasht"], 0.89),
    ("site_setup_control_act", ["akt kontroll", "ngritje", "kantier"], 0.88),
    ("structure_setting_out_control_act", ["akt kontroll", "piket"], 0.88),
    ("construction_permit_conformity_declaration", ["deklar", "perputh", "leje ndertimi"], 0.9),
    ("construction_permit_conformity_declaration", ["deklar", "konformitet"], 0.84),
    ("professional_liability_insurance_policy", ["polic", "sigur", "pergjegjesi", "profesional"], 0.9),
    ("professional_liability_insurance_policy", ["kontrat", "sigur", "pergjegjesi", "profesional"], 0.86),
    ("technical_administrative_document_handover_act", ["akt", "dorezim", "dokumentacion", "teknik", "administrativ"], 0.89),
    ("site_handover_act", ["akt", "dorezim", "shesh"], 0.88),
    ("start_works_notification_letter", ["shkrese", "njoftim", "fillim", "punim"], 0.88),
    ("start_works_notification", ["njoftim", "fillim", "punim"], 0.84),
    ("start_works_minutes", ["procesverbal", "fillim", "punim"], 0.86),
    ("start_interruption_extension_completion_minutes", ["procesverbal", "perfundim", "punim"], 0.87),
    ("completion_minutes", ["procesverbal", "perfundim", "punim"], 0.86),
    ("start_interruption_extension_completion_minutes", ["procesverbal", "nderprerje", "punim"], 0.86),
    ("start_interruption_extension_completion_minutes", ["procesverbal", "shtyrje", "punim"], 0.86),
    ("forty_five_day_report", ["raport", "45", "dit"], 0.88),
    ("forty_five_day_report", ["raport", "dyzet e pese"], 0.88),
    ("supervisor_contract", ["kontrat", "mbikeqyr"], 0.93),
    ("supervisor_contract", ["kontrat", "mbikqyr"], 0.93),
    ("supervisor_contract", ["kontrat", "mbiqkyr"], 0.91),
    ("development_permit", ["leje zhvillimi"], 0.86),
    ("construction_permit", ["leje ndertimi"], 0.86),
    ("approved_execution_project", ["projekt zbatimi"], 0.84),
    ("approved_execution_project", ["projekti i zbatimit"], 0.84),
    ("technical_opposition", ["oponenc", "teknik"], 0.84),
    ("bill_of_quantities", ["preventiv"], 0.82),
    ("geological_engineering_study", ["gjeolog", "inxhinier"], 0.84),
    ("topographic_documentation", ["topograf"], 0.82),
    ("seismic_study", ["sizmik"], 0.82),
    ("construction_organization_plan", ["planorganizim"], 0.84),
    ("construction_organization_plan", ["organizim", "kantier"], 0.8),
    ("professional_license", ["licenc", "profesional"], 0.82),
    ("professional_license", ["certifikat", "profesional"], 0.8),
    ("setting_out_act", ["akt", "piket"], 0.82),
    ("site_book", ["libri", "kantier"], 0.84),
    ("daily_site_log", ["ditari", "objekt"], 0.82),
    ("daily_site_log", ["ditari", "punim"], 0.82),
    ("project_schedule", ["afati", "punim"], 0.86),
    ("project_schedule", ["task", "duration", "start", "finish"], 0.84),
    ("project_schedule", ["kronologji", "punim"], 0.84),
    ("monthly_situations", ["situacion", "mujor"], 0.82),
    ("hidden_works_minutes", ["punim", "maskuar"], 0.84),
    ("hidden_works_minutes", ["punim", "mask"], 0.82),
    ("material_quality_certificate", ["certifikat", "ciles", "material"], 0.86),
    ("material_quality_certificate", ["certifikat", "konformitet", "material"], 0.84),
    ("technical_declaration", ["deklar", "teknik"], 0.82),
    ("technical_declaration", ["deklar", "mbikqyr"], 0.8),
    ("technical_declaration", ["deklar", "sipermarres"], 0.8),
    ("safety_documentation", ["siguri", "kantier"], 0.8),
    ("safety_documentation", ["sigurim teknik", "punim"], 0.8),
    ("photo_video_documentation", ["foto", "video"], 0.78),
    ("photo_video_documentation", ["dokumentacion", "fotograf"], 0.78),
    ("as_built_project", ["azhorn", "projekt"], 0.82),
    ("as_built_project", ["as built", "projekt"], 0.82),
    ("maintenance_project", ["projekt", "mirembajt"], 0.82),
    ("maintenance_project", ["projekt", "mirmbajt"], 0.8),
    ("kolaudim_act", ["akt", "kolaudim"], 0.82),
    ("contract_and_related_acts", ["kontrat", "akte"], 0.76),
    ("accounting_records", ["dokumentacion", "kontabil"], 0.78),
    ("accounting_records", ["liber", "kontabil"], 0.78),
    ("control_act", ["akt kontroll"], 0.72),
    ("control_act", ["aktkontroll"], 0.72),
]
# What a file's name says.
NAME = [
    ("professional_liability_insurance_policy", ["polic", "sigur"], 0.98),
    ("professional_liability_insurance_policy", ["kontrat", "sigur", "pergjegjesi"], 0.98),
    ("supervisor_contract", ["kontrat", "mbikeqyr"], 0.98),
    ("supervisor_contract", ["kontrat", "mbikqyr"], 0.98),
    ("supervisor_contract", ["kontrat", "mbiqkyr"], 0.96),
    ("contract_and_related_acts", ["kontrat", "kolaudator"], 0.94),
    ("daily_site_log", ["ditari", "punim"], 0.98),
    ("daily_site_log", ["ditari", "objekt"], 0.98),
    ("project_schedule", ["kronologji"], 0.98),
    ("project_schedule", ["afati", "punim"], 0.98),
    ("project_schedule", ["schedule"], 0.94),
    ("site_book", ["libri", "kantier"], 0.98),
    ("start_works_notification", ["njoftim", "fillim", "punim"], 0.98),
    ("site_handover_act", ["akt", "dorezim", "shesh"], 0.98),
    ("start_works_minutes", ["proces", "verbal", "fillim"], 0.98),
    ("setting_out_act", ["proces", "verbal", "akt", "piket"], 0.98),
    ("site_setup_control_act", ["akt", "kontroll", "ngritje", "kantier"], 0.99),
    ("structure_setting_out_control_act", ["akt", "kontroll", "piket"], 0.99),
    ("level_0_00_control_act", ["akt", "kontroll", "0.00"], 0.97),
    ("foundation_completion_and_level_0_00_control_act", ["akt", "kontroll", "perfundim", "theme"], 0.99),
    ("foundation_completion_and_level_0_00_control_act", ["proces", "verbal", "theme", "0.00"], 0.94),
    ("structural_frame_completion_control_act", ["akt", "kontroll", "perfundim", "karabina"], 0.99),
    ("facade_and_finishing_completion_control_act", ["akt", "kontroll", "perfundim", "fasad", "rifinitur"], 0.99),
    ("external_system_completion_control_act", ["akt", "kontroll", "sistem", "jasht"], 0.99),
    ("external_system_completion_control_act", ["akt", "kontroll", "sistemim", "jasht"], 0.99),
    ("start_interruption_extension_completion_minutes", ["proces", "verbal", "perfundim", "punim"], 0.96),
    ("start_interruption_extension_completion_minutes", ["proces", "verbal", "perfundim", "ndertim"], 0.94),
    ("hidden_works_minutes", ["punim", "mask"], 0.98),
    ("maintenance_project", ["projekt", "mirembajt"], 0.98),
    ("maintenance_project", ["projekt", "mirmbajt"], 0.96),
    ("construction_permit_conformity_declaration", ["deklar", "konformitet"], 0.98),
    ("technical_declaration", ["deklar", "mbikqyr"], 0.96),
    ("technical_declaration", ["deklar", "mbikeqyr"], 0.96),
    ("technical_declaration", ["deklar", "sipermarres"], 0.96),
    ("kolaudim_act", ["akt", "kolaudim"], 0.98),
    ("construction_permit", ["leje", "ndertimi"], 0.98),
    ("development_permit", ["leje", "zhvillimi"], 0.98),
    ("approved_execution_project", ["projekt", "zbatimi"], 0.96),
    ("bill_of_quantities", ["preventiv"], 0.96),
    ("geological_engineering_study", ["gjeolog", "inxhinier"], 0.96),
    ("topographic_documentation", ["topograf"], 0.94),
    ("seismic_study", ["sizmik"], 0.94),
    ("construction_organization_plan", ["planorganizim"], 0.96),
    ("professional_license", ["licenc"], 0.94),
    ("forty_five_day_report", ["raport", "45"], 0.96),
]
# What makes a text a law rather than a document, and what heads a permit.
LAW_NAMES = ["vkm", "vendim", "ligj", "udhezim"]
LAW_WORDS = ["keshilli i ministrave", "republika e shqiperise", "fletore zyrtare", "vendim nr", "gazeta zyrtare"]
CONSTRUCTION_HEADS, DEVELOPMENT_HEADS = ["i jepet", "zhvilluesit", "leja e ndertimit per punimet"], ["i jepet", "zhvilluesit", "vendim"]
