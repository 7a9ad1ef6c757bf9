import sys

from sheetloom.cli import main

sys.exit(main())
