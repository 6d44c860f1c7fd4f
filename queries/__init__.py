"""Registered queries: every operator over the driver tables, with its SQL twin."""

from queries import (
    dashboards, intake, inventory, logs, models, reports, scanning, selection, trees)

MODULES = [dashboards, logs, scanning, selection, reports, intake, inventory, models, trees]
