"""changelens: Spark-native code-change risk analytics.

Sub-packages:
  sources    - validated Parquet scans, report sinks, model save/load
  functions  - column-expression builders (text metrics, context features)
  operators  - DataFrame operators (join/label, sampling, reports,
               evaluation, preprocessing, TF-IDF/SVD, SMOTE, models)
  plans      - end-to-end flows and the registered query catalogue
  streaming  - the stateless feature operators applied to a stream
"""

__version__ = "0.1.0"
