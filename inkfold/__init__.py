"""inkfold: document analytics on Spark DataFrames.

Recogniser answers, page texts, layout records and metric points go in as
tables; documents, entities, fields, exports and alerts come out as tables.
"""
