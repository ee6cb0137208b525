"""wearcast: outdoor outfit analytics as Spark DataFrame operators.

Modules, by the work they do:

* ``wearcast.operators.cleaning``     clean labelled activity logs (``clean_activity_log``)
* ``wearcast.sources``                CSV logs, workbook exports, hourly weather JSON, snapshots
* ``wearcast.operators.observations`` hour points -> observations
* ``wearcast.operators.store``        newest write per key, whole-day upsert, routed lookups
* ``wearcast.operators.location``     place parsing and coordinates
* ``wearcast.operators.model``        one decision tree per outfit item (fit, predict, score, save/load)
* ``wearcast.operators.recommend``    requests -> observation -> outfit -> reply
* ``wearcast.operators.reply``        activity profiles and English replies
* ``wearcast.operators.generate``     random scenarios for building labelled data
* ``wearcast.streaming.ingest``       continuous ingest and scoring
* ``wearcast.functions``              the column expressions the operators are built from
"""

__version__ = "0.1.0"
