from lodeframe.cli import main

raise SystemExit(main())
